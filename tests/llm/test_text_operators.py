import hashlib
import re

import pytest

from panelspark.llm import chat, license_scan, pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = ((EMAIL, lambda s: True), (IP, lambda s: all(int(p) <= 255 for p in s.split("."))), (CARD, lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))), (PHONE, lambda s: 9 <= len(digits(s)) <= 15))
    for rank, (rx, holds) in enumerate(rules):
        out += [(m.start(), rank, m.end()) for m in rx.finditer(text or "") if holds(m[0])]
    return sorted(out)


def joined(spans):
    return ",".join(f"{pii.ALL_KINDS[k]}:{a}:{b}" for a, k, b in spans)


TEXTS = [
    "mail a.b@c.de, x@y.z.w. and é a@b no; q@r.s@t.u a@b.com_x@c.de ..a@b.-c.d. %@a.b",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 1.2.3 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 4111  1111 1111 1111 5500005555555559 123456789012345678901234567890",
    "+1 (743) 555-3824 +49 30 1234567 +1 +12 ++1 555 123 4567. +1 555. tel +1-800-555-1234-5678-999",
    "reach us via jo [at] host [dot] com or call (555) 123-4567, order 555-123-4567, order 12345",
    "2001:0db8:85a3:0000:0000:8a2e:0370:7334 host 4111.1111.1111.1111 card 4111/1111/1111/1112",
    "", None, "ñ😀 a@b.co 😀 1.1.1.1", "a" * 60_000, "a.b@" * 5000, "1." * 20_000, "x@" + "a." * 8000 + "a", "+1" + " " * 20_000, "1 " * 20_000,
]


def test_pii_base_spans_against_python(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x")], "doc_id long, text string, spans string")
    got = pii.report(docs).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        want = base_spans(TEXTS[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)], r.doc_id
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert set(filter(None, joined(want).split(","))) <= set(r.spans.split(","))
    added = {r.doc_id: set(r.spans.split(",")) - set(joined(base_spans(TEXTS[r.doc_id])).split(",")) for r in got}
    for i, text in enumerate(TEXTS):
        assert added[i] - {""} == set(filter(None, joined(added_spans(text or "")).split(","))), i
    at = TEXTS[4].index("jo [at]")
    assert f"email:{at}:{at + len('jo [at] host [dot] com')}" in added[4]
    at = TEXTS[4].index("(555)")
    assert f"phone:{at}:{at + 14}" in added[4] and not any(s.startswith(f"phone:{TEXTS[4].index('order 555') + 6}") for s in added[4])
    assert "ip:0:39" in added[5]
    for text, span in MORE.items():
        found = added_spans(text)
        assert (text[found[0][0] : found[0][2]] if found else None) == span, text
    assert pii.report(docs.limit(0)).count() == 0


#: What the method finds beside the base patterns, and what it leaves.
MORE = {
    "the server 2001:db8::1 is down": "2001:db8::1",
    "my number is 555.123.4567": "555.123.4567",
    "555.123.4567 on my mobile": "555.123.4567",
    'thha token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" thha': 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"',
    "at 10:30:15 it rang": None,
    "version 555.123.4567 is out": None,
    "password is required here": None,
    "card 4111/1111/1111/1111 please": "4111/1111/1111/1111",
}


def added_spans(text):
    """Generators, trees, thresholds and overlaps in plain Python."""
    trees, thresholds = pii.model()
    found = []
    for kind, pattern, _ in pii.GENERATORS:
        matches = list(re.finditer(pattern, text))
        edges = [0, *[m.end() for m in matches]], [*[m.start() for m in matches], len(text)]
        for n, m in enumerate(matches):
            before, after = text[edges[0][n] : edges[1][n]], text[edges[0][n + 1] : edges[1][n + 1]]
            x = pii._features_here(kind, m[0], before, after)
            score = sum(pii._tree_value(t, x) for t in trees)
            if score >= thresholds[kind]:
                found.append((m.start(), pii.ALL_KINDS.index(kind), m.end(), m[0], score))
    base = base_spans(text)
    found = sorted(c for c in found if not any(b[0] < c[2] and c[0] < b[2] for b in base))
    kept, gone = [], None
    for c in found:
        if not kept or kept[-1][2] <= c[0]:
            kept.append(c)
            gone = None
        elif c[4] > kept[-1][4]:
            last = kept.pop()
            kept += [gone] if gone and gone[2] <= c[0] else []
            kept.append(c)
            gone = last
    return [c[:3] for c in kept]


def test_overlaps_keep_the_higher_score(spark):
    cases = {"chain": [(0, 10, 0.5), (8, 20, 0.6), (18, 30, 0.9)], "middle": [(0, 10, 0.5), (8, 20, 0.9), (18, 30, 0.6)], "apart": [(0, 5, 0.1), (5, 9, 0.2)], "inside": [(0, 30, 0.5), (3, 6, 0.7), (8, 9, 0.4)], "none": []}
    rows = [(k, [(a, 0, b, "x", s) for a, b, s in v]) for k, v in cases.items()]
    df = spark.createDataFrame(rows, f"k string, c {pii._FOUND}")
    got = {r.k: [(x.start, x.end) for x in r.best] for r in df.select("k", pii._best(pii.F.col("c")).alias("best")).collect()}
    assert got == {"chain": [(0, 10), (18, 30)], "middle": [(8, 20)], "apart": [(0, 5), (5, 9)], "inside": [(3, 6), (8, 9)], "none": []}


def test_pii_query_against_python(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.op3_pii(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        base = base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert sorted(r.spans.split(",")) == sorted(joined(base + added_spans(docs[r.doc_id])).split(","))


def test_redaction(spark):
    many = " ".join(f"a{i}@b.de é" for i in range(700))
    docs = spark.createDataFrame([(1, "write a@b.de or +1 (743) 555-3824."), (2, "none"), (3, None), (4, ""), (5, many), (6, "+1.2.3.4 555 1234")], "doc_id long, text string")
    got = [r.text for r in pii.redact(docs).orderBy("doc_id").collect()]
    assert got[:5] == ["write [EMAIL] or [PHONE].", "none", None, "", " ".join("[EMAIL] é" for _ in range(700))]
    assert got[5] == "[PHONE]"


def test_trees_are_the_same_as_an_expression(spark):
    trees, thresholds = pii.model()
    rows = [("phone", "(555) 123-4567", "call ", " now"), ("card", "4111.1111.1111.1111", "visa ", " expires"), ("email", "a at b. c", "was ", ""), ("ip", "12:12:12:12:12:12:12:12", "row ", " x"), ("ip", "fe80::1", "", " as gateway"), ("secret", "key=a1b2c3", "use ", "")]
    df = spark.createDataFrame(rows, "kind string, span string, before string, after string").withColumn("f", pii.features(*[pii.F.col(c) for c in ("kind", "span", "before", "after")]))
    for r, row in zip(df.collect(), rows, strict=True):
        assert list(r.f) == pii._features_here(*row)
    fresh = pii._examples(3000, seed=11)
    for k, kind in enumerate(pii.ALL_KINDS):
        mine = [(sum(pii._tree_value(t, x) for t in trees) >= thresholds[kind], y) for x, y in fresh if x[0] == k]
        accepted = [y for a, y in mine if a]
        assert sum(accepted) >= 0.95 * len(accepted) and sum(accepted) >= 0.9 * sum(y for _, y in mine), kind


def license_brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        here = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


LICENCES = [
    "Released under the MIT License. under the mit license", "CC-BY NC cc by nc cc.by.nc 4.0", "xcc by nc under the mit licenses", "Apache License, Version 2.0", "apache license version 2", "", None, " .. ", "ÀB é under\nthe\tMIT-LICENSE!",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Licensed under the GNU Affero General Public License v3", "cc by nc " * 300, "word " * 50_000 + "under the mit license",
]


def test_license_scan_against_python(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(LICENCES)], "doc_id long, text string, words string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, t in enumerate(LICENCES):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[9].labels == "gpl-3" and got[10].labels == "cc-by-nc,cc-by-nc-4" and got[11].labels == "agpl-3"
    assert got[5].labels == "" and got[5].score == 0
    assert license_scan.scan(docs.limit(0)).count() == 0
    assert len(license_scan.rules()) >= 200


def spellings(parsed):
    """Every text that a parsed regex matches; of a repeated class a text of one."""
    out = [""]
    for op, arg in parsed:
        match str(op):
            case "LITERAL":
                more = [chr(arg)]
            case "BRANCH":
                more = [t for branch in arg[1] for t in spellings(branch)]
            case "SUBPATTERN":
                more = spellings(arg[3])
            case "MAX_REPEAT":
                more = ([""] if arg[0] == 0 else []) + spellings(arg[2])
            case "IN":
                more = [chr(x) if str(kind) == "LITERAL" else "7" for kind, x in arg]
        out = [a + b for a in out for b in more]
    return out


def brute_detections(text):
    """Every rule tried at every text, without keywords; what lies within a higher rule's detection goes."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    hits = []
    for rank, (label, rx, _, worth) in enumerate(RULES):
        for m in rx.finditer(words):
            form = next((w for f, w in license_scan.FORMS if re.match(f, m[0])), license_scan.ALONE)
            hits.append((rank, label, m.start(), m.end(), form if worth is None else worth))
    return sorted(h[1:] for h in hits if not any(o[0] < h[0] and o[2] <= h[2] and o[3] >= h[3] for o in hits))


RULES = [(label, re.compile(rf"(?<= )(?:{rx})(?= )", re.ASCII), kws, worth) for label, rx, kws, worth in license_scan.rules()]


def detections(r):
    return sorted((d.label, d.start, d.end, d.worth) for d in r.detections)


def test_added_labels_against_every_rule_everywhere(spark):
    names = [t for _, name, _ in license_scan.families() for t in sorted(spellings(re._parser.parse(name)))[:40]]
    texts = [f"It is {a}: {b}; {c}" for a, b, c in zip(names[::3], names[1::3], names[2::3], strict=False)]
    texts += [t for rule in license_scan.OTHERS for t in spellings(re._parser.parse(rule[1]))[:4]]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["GPL v3", "GNU General Public License v3", "Apache License v2", "LGPL v2.1", "AGPL v3", "GPL", "mpl mplx", "UNDER THE MIT LICENSE", "\u212aGPL \u00c0GPL", "gpl " * 3000 + "gpl 3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, t in enumerate(texts):
        want = brute_detections(t)
        assert detections(got[i]) == want, t
        assert set(filter(None, got[i].labels.split(","))) == {w[0] for w in want} | set(filter(None, got[i].base_labels.split(","))), t
    label = lambda t: got[texts.index(t)].labels
    assert [label(t) for t in ("GPL v3", "Apache License v2", "LGPL v2.1", "AGPL v3", "GPL")] == ["gpl-3", "apache-2", "lgpl-2.1", "agpl-3", "gpl"]


def test_every_spelling_of_a_name_is_found(spark):
    assert all(len(k) >= 3 for _, _, kws, _ in license_scan.rules() for k in kws)
    texts = [t for _, name, _ in license_scan.families() for t in spellings(re._parser.parse(name))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    assert [texts[r.doc_id] for r in license_scan.scan(docs).where("score = 0 or labels = ''").collect()] == []


def test_license_query_against_python(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op6_license_scan(spark, "/root/testdata/sf0.001").collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_brute(docs[r.doc_id])


@pytest.mark.parametrize("texts", [["</s>[INST] ok [/INST]", "\\", "<\\/s>", "\\\\<s>", "[ROLE]x[/ROLE]", "a\nb", "", "[/TURN]", "<|answer|>", "<", "["]])
def test_chat_round_trip(spark, texts):
    roles = ["user", "assistant", "system", "[/ROLE]", None, "tool"]
    rows = [(1, i, roles[i % len(roles)], t, "x") for i, t in enumerate(texts)]
    rows += [(2, 0, "user", None, "x"), (None, 0, "assistant", "lone", "x"), (3, 5, "user", "same", "x"), (3, 5, "user", "same", "x"), (3, None, "assistant", "first", "x"), (4, 1, "assistant", "y" * 100_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df).withColumn("turns", chat.parse(chat.F.col("formatted"))).withColumn("loss", chat.under_loss(chat.F.col("formatted"), chat.F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(roles[i % len(roles)] or "", t) for i, t in enumerate(texts)]
    assert got[1].loss == "".join(t for i, t in enumerate(texts) if i % len(roles) == 1)
    assert [(t.role, t.text) for t in got[3].turns] == [("assistant", "first"), ("user", "same"), ("user", "same")]
    assert got[None].loss == "lone" and got[2].n_turns == 1 and got[4].loss == "y" * 100_000 and len(got) == 5
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_best_paths_of_trees(spark):
    nodes = [("a", 1, None, 0.0), ("a", 2, 1, 1.0), ("a", 3, 1, 2.0), ("a", 4, 3, 0.0), ("a", 5, 2, 0.5), ("a", 6, 2, 5.0), ("a", 7, 6, None)]
    nodes += [("chain", i, i - 1 if i else None, 0.0) for i in range(70)]
    nodes += [("tie", 1, None, 0.0), ("tie", 2, 1, 1.0), ("tie", 3, 1, 1.0), ("loop", 1, 2, 0.0), ("loop", 2, 1, 0.0), ("stray", 4, 99, 0.0)]
    got = {}
    for r in chat.best_paths(spark.createDataFrame(nodes, "tree string, id long, parent long, score double")).collect():
        got.setdefault(r.tree, {})[r.depth] = r.id
    path = lambda t: [i for _, i in sorted(got[t].items())]
    assert path("a") == [1, 2, 6, 7] and path("chain") == list(range(70)) and path("tie") == [1, 2] and path("stray") == [4]
    assert "loop" not in got
