"""Personal data: exact base patterns, and candidates of wider patterns that gradient-boosted trees accept.

The base patterns are found and kept as they stand. Beside them, generators of high recall propose spans of unusual form
(spelled-out addresses, numbers without a plus, cards with other separators, IPv6 in full and shortened, assigned secrets):
many proposals are wrong, and they may overlap. Boosted trees over their form and the words before and after them give
each a score; a threshold for each kind, calibrated for precision on held-out examples, selects, and of those that overlap
the higher score stays. The trees are learned on the driver from generated labelled sentences, a fixed number of them, and
become one expression.

Native: DataFrame functions only.
"""

from __future__ import annotations

import math
import random
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import CONTEXT_CHARS, match_spans

#: Kinds of the base patterns, and all kinds that the method knows.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Base patterns. A start inside a run that has failed cannot succeed, so each starts where a run does, or where the last match ended; and takes linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Generators: kind, pattern, and what every text with a match holds, cheaper to look for. No match of one is longer than a few hundred characters.
GENERATORS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}|<at>| at |\(@\)|\[@\]| @ ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}|<dot>| dot |\.) ?[A-Za-z0-9-]{2,63}){1,4}", r"[(\[{< ](?:at|@)[)\]}> ]"),
    ("ip", r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{2,39}(?![0-9A-Za-z:])", r":[0-9A-Fa-f]{0,4}:"),
    ("card", r"(?<![0-9])(?:[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[0-9]{3}([._/])[0-9]{6}\2[0-9]{5})(?![0-9])", r"[0-9]{4}[._/][0-9]{4}[._/]|3[0-9]{3}[._/][0-9]{6}[._/]"),
    ("phone", r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[ .-][0-9])", r"[0-9]{3}[ .)-] ?[0-9]{3}[ .-][0-9]{4}"),
    ("phone", r"(?<![0-9+(.-])(?:00[1-9][0-9]{0,2}[ .-]|0[1-9][0-9]{1,4}[ /-])[0-9](?:[ .-]?[0-9]){4,11}(?![0-9])", r"(?<![0-9])0(?:0[1-9][0-9]{0,2}[ .-]|[1-9][0-9]{1,4}[ /-])[0-9]"),
    ("secret", r"(?i)(?<![a-z0-9])(?:[a-z]{1,12}[_-]){0,2}(?:token|secret|password|passwd|pwd|key|bearer|credential)s?[\x22\x27]?(?: ?[:=]{1,2} ?| is )[\x22\x27]?[A-Za-z0-9+/_=.-]{6,200}[\x22\x27]?", r"(?i)(?:token|secret|password|passwd|pwd|key|bearer|credential)s?[\x22\x27]?(?: ?[:=]| is )"),
    ("secret", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|xox[abprs]-[A-Za-z0-9-]{10,72}|eyJ[A-Za-z0-9_-]{10,200}\.[A-Za-z0-9_-]{10,400}\.[A-Za-z0-9_-]{10,200})", r"AKIA|gh[pousr]_|sk-|xox[abprs]-|eyJ"),
)
#: A text without one of these has no candidates.
CANDIDATE_GATE = r"[(\[{< ](?:at|@)[)\]}> ]|[0-9A-Fa-f]:[0-9A-Fa-f:]|::[0-9A-Fa-f]|[0-9]{3}[ .)_/-]|0[1-9][0-9]{0,3}[ /.-][0-9]|(?i:token|secret|passw|pwd|key|bearer|credential)s?[\x22\x27 :=]|AKIA|gh[pousr]_|sk-|xox[abprs]-|eyJ"
#: What the words about a span speak of: looked for before it and after it.
CONTEXTS = (r"(?i)(?:e-?mail|mail|contact|write|reach)", r"(?i)(?:phone|tel\b|call|mobile|fax|cell|contact|reach|number is|dial|text me|whatsapp)", r"(?i)(?:card|visa|amex|credit|payment|pay\b|expir|cvv)", r"(?i)(?:\bip\b|ipv6|host|server|address|addr|ping|subnet|gateway)", r"(?i)(?:order|invoice|ref\b|isbn|serial|version|part|ratio|page|total|row|score|time|id\b|sku)")
#: Labelled examples, trees, their depth, learning rate, and the precision that each kind's threshold is calibrated for.
EXAMPLES, TREES, DEPTH, RATE, PRECISION = 3000, 30, 3, 0.3, 0.98


# ---------------------------------------------------------------- features

FEATURES = (
    "kind", "digits", "letters", "length", "dots", "brackets", "luhn", "spelled_at", "known_tld", "colons", "gap", "hex_letters", "mixed",
    "mail_before", "phone_before", "card_before", "host_before", "other_before", "mail_after", "phone_after", "card_after", "host_after", "other_after",
)
#: What follows a span speaks of it up to the end of the clause.
_CLAUSE = r"^[^,.;!?\n]*"
_SPELLED, _TLD, _MIXED = r"[(\[{<](?:at|@)[)\]}>]", r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk)$", r"[0-9][A-Za-z].*[0-9][A-Za-z]|[A-Za-z][0-9].*[A-Za-z][0-9]"


def _digit_sum(digits: Column, double: int) -> Column:
    """Luhn's sum of a string of digits; every second from the right is doubled."""
    size = F.length(digits)
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(size, F.lit(1))),
        F.lit(0),
        lambda acc, i: acc + F.when((size - i) % 2 == double, F.substring(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )


def luhn(digits: Column) -> Column:
    return F.when(F.length(digits) > 0, _digit_sum(digits, 1) % 10 == 0).otherwise(False)


def _only(text: Column, what: str) -> Column:
    return F.regexp_replace(text, f"[^{what}]+", "")


def features(kind: Column, span: Column, before: Column, after: Column) -> Column:
    """struct of the features of a candidate, all doubles."""
    number = lambda c: c.cast("double")
    digits, after = _only(span, "0-9"), F.regexp_extract(after, _CLAUSE, 0)
    values = [
        number(F.array_position(F.array(*map(F.lit, ALL_KINDS)), kind) - 1),
        number(F.length(digits)),
        number(F.length(_only(span, "A-Za-z"))),
        number(F.length(span)),
        number(F.length(_only(span, "."))),
        number(span.rlike(r"[(\[{<]")),
        number(F.when(kind == "card", luhn(digits)).otherwise(False)),
        number(span.rlike(_SPELLED)),
        number(span.rlike(_TLD)),
        number(F.length(_only(span, ":"))),
        number(span.contains("::")),
        number(F.length(_only(span, "a-fA-F"))),
        number(span.rlike(_MIXED)),
        *[number(before.rlike(c)) for c in CONTEXTS],
        *[number(after.rlike(c)) for c in CONTEXTS],
    ]
    return F.struct(*[v.alias(n) for v, n in zip(values, FEATURES, strict=True)])


def _features_here(kind: str, span: str, before: str, after: str) -> list[float]:
    """The same features of one example, on the driver."""
    count = lambda what: float(len(re.findall(f"[{what}]", span)))
    digits = re.sub(r"[^0-9]+", "", span)
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    before, after = before[-CONTEXT_CHARS:], re.search(_CLAUSE, after[:CONTEXT_CHARS])[0]
    return [
        float(ALL_KINDS.index(kind)),
        float(len(digits)),
        count("A-Za-z"),
        float(len(span)),
        count("."),
        float(bool(re.search(r"[(\[{<]", span))),
        float(kind == "card" and bool(digits) and total % 10 == 0),
        float(bool(re.search(_SPELLED, span))),
        float(bool(re.search(_TLD, span))),
        count(":"),
        float("::" in span),
        count("a-fA-F"),
        float(bool(re.search(_MIXED, span))),
        *[float(bool(re.search(c, before))) for c in CONTEXTS],
        *[float(bool(re.search(c, after))) for c in CONTEXTS],
    ]


# ---------------------------------------------------------------- labelled sentences and boosting


def _examples(n: int, seed: int = 7) -> list[tuple[list[float], int]]:
    """Generated labelled candidates: each with the words before and after it."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    good = {"email": ("mail me: ", "contact ", "my e-mail is ", "reach us via "), "phone": ("call ", "tel. ", "phone: ", "mobile ", "my number is ", "dial "), "card": ("card ", "visa ", "pay with ", "credit card no "), "ip": ("server ", "host ", "ipv6 address ", "ip ", "ping "), "secret": ("export ", "set ", "use ", "with ")}
    later = {"email": (" to write to me", " is my mail"), "phone": (" on my mobile", " to call"), "card": (" expires 11/27", " my card"), "ip": (" is the host", " as gateway"), "secret": (" in the config", " for login")}
    bad = ("order ", "invoice ", "ref ", "isbn ", "serial ", "version ", "part ", "row ", "page ", "score ", "time ")
    plain = ("", "and the ", "it was ", "then ")

    def card(valid: bool) -> str:
        body = digits(15)
        check = next(str(c) for c in range(10) if sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(body + str(c)))) % 10 == 0)
        last = check if valid else str((int(check) + r.randint(1, 9)) % 10)
        s, sep = body + last, r.choice("._/")
        return sep.join(s[i : i + 4] for i in range(0, 16, 4))

    def address(real: bool) -> str:
        if not real:
            return r.choice((":".join(digits(2) for _ in range(r.randint(3, 8))), f"{digits(1)}:{digits(2)}:{digits(2)}", f"{word()[:2].translate(str.maketrans('ghijklmnoprstuvw', 'abcdefabcdefabcd'))}::{digits(1)}"))
        if r.random() < 0.5:
            return ":".join(hexes(4) for _ in range(8))
        return f"{r.choice(('2001', '2a02', 'fe80', 'fd00'))}:{hexes(r.randint(2, 4))}{r.choice(('', ':' + hexes(4)))}::{hexes(r.randint(1, 4))}"

    def number(real: bool) -> str:
        a, b, c = digits(3), digits(3), digits(4)
        local = f"0{r.randint(1, 9)}{digits(2)}{r.choice(' /-')}{digits(r.randint(6, 8))}"
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", local, f"00{r.randint(20, 99)} {digits(3)} {digits(6)}")) if real else r.choice((f"{a} {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", local))

    def secret(real: bool) -> str:
        name = r.choice(("token", "api_key", "password", "secret", "TOKEN", "access-key"))
        value = r.choice((hexes(40), hexes(32), "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789") for _ in range(r.randint(16, 40))))) if real else r.choice((word() + word(), "required", word().capitalize() + word(), digits(6)))
        quote = r.choice(('"', "'", "")) if real else ""
        return f"{name}{r.choice((' = ', '=', ': '))}{quote}{value}{quote}"

    out = []
    for _ in range(n):
        kind, real = r.choice(ALL_KINDS), r.random() < 0.5
        told = r.random()
        before = r.choice(good[kind]) if real and told < 0.7 else r.choice(bad) if not real and told < 0.65 else r.choice(plain)
        after = r.choice(later[kind]) if real and told > 0.6 else " " + r.choice(bad) if not real and told > 0.8 else " " + word()
        if kind == "phone" and real and told >= 0.95:
            before = r.choice(good[kind])  # a number that nothing speaks of is as often none
        if kind == "email":
            if real:
                at, dot = r.choice((("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), ("{at}", "{dot}"), ("[at]", "."), (" @ ", ".")))
                span = f"{word()}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr'))}"
            else:
                span = f"{word()} at {word()}{r.choice(('. ', '.'))}{word()}"
        else:
            span = {"phone": number, "card": card, "ip": address, "secret": secret}[kind](real)
        out.append((_features_here(kind, span, before, after), int(real)))
    return out


def _fit_tree(x: list[list[float]], gradient: list[float], weight: list[float], at: list[int], depth: int):
    """A regression tree: (feature, cut, left, right) or a value."""
    g, h = sum(gradient[i] for i in at), sum(weight[i] for i in at)
    value = RATE * g / (h + 1.0)
    if depth == 0 or len(at) < 16:
        return value
    best = None
    for f in range(len(FEATURES)):
        for cut in sorted({x[i][f] for i in at})[:-1]:
            gl = sum(gradient[i] for i in at if x[i][f] <= cut)
            hl = sum(weight[i] for i in at if x[i][f] <= cut)
            gain = gl * gl / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0) - g * g / (h + 1.0)
            if gain > 1e-6 and (best is None or gain > best[0]):
                best = (gain, f, cut)
    if best is None:
        return value
    _, f, cut = best
    return (f, cut, _fit_tree(x, gradient, weight, [i for i in at if x[i][f] <= cut], depth - 1), _fit_tree(x, gradient, weight, [i for i in at if x[i][f] > cut], depth - 1))


def _tree_value(tree, row: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


_MODEL: list = []


def model() -> tuple[list, dict[str, float]]:
    """(trees, for each kind the threshold of their sum), learned once a process from the generated sentences: always the same."""
    if not _MODEL:
        examples = _examples(EXAMPLES)
        train, held = examples[: EXAMPLES // 2], examples[EXAMPLES // 2 :]
        x, y = [e[0] for e in train], [e[1] for e in train]
        score, trees = [0.0] * len(x), []
        for _ in range(TREES):
            p = [1 / (1 + math.exp(-s)) for s in score]
            trees.append(_fit_tree(x, [t - q for t, q in zip(y, p, strict=True)], [q * (1 - q) for q in p], list(range(len(x))), DEPTH))
            score = [s + _tree_value(trees[-1], row) for s, row in zip(score, x, strict=True)]
        thresholds = {}
        for k, kind in enumerate(ALL_KINDS):
            ranked = sorted(((sum(_tree_value(t, row) for t in trees), label) for row, label in held if row[0] == k), reverse=True)
            thresholds[kind], right = math.inf, 0
            for n, (s, label) in enumerate(ranked, 1):
                right += label
                if (n == len(ranked) or ranked[n][0] < s) and right / n >= PRECISION:  # equal scores stand or fall together
                    thresholds[kind] = s
        _MODEL.append((trees, thresholds))
    return _MODEL[0]


def _tree_expression(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(f[FEATURES[tree[0]]] <= tree[1], _tree_expression(tree[2], f)).otherwise(_tree_expression(tree[3], f))


# ---------------------------------------------------------------- spans

_SPANS = "array<struct<start:int,rank:int,end:int,span:string>>"
_FOUND = "array<struct<start:int,rank:int,end:int,span:string,score:double>>"


def _none(kind: str = _SPANS) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _spans(text: Column, pattern: str, rank: int) -> Column:
    """Every match as (start, rank, end, span), in code points."""
    return F.transform(match_spans(text, pattern), lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), m["span"].alias("span")))


def _holds(kind: str, span: Column) -> Column:
    """Which matches of a base pattern count."""
    if kind == "ip":
        return span.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    digits = _only(span, "0-9")
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def holds_for(kind: str):
    return lambda s: _holds(kind, s["span"])


def _scored(text: Column, kind: str, pattern: str) -> Column:
    """The candidates of a generator that the trees accept for its kind, with their scores."""
    trees, thresholds = model()
    rank = ALL_KINDS.index(kind)

    def score(m):
        f = F.array(features(F.lit(kind), m["span"], m["before"], m["after"]))
        return F.get(F.transform(f, lambda x: reduce(lambda a, b: a + b, [_tree_expression(t, x) for t in trees])), 0)

    found = F.transform(match_spans(text, pattern), lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), m["span"].alias("span"), score(m).alias("score")))
    return F.filter(found, lambda c: c["score"] >= thresholds[kind])


def _best(candidates: Column) -> Column:
    """Of candidates that overlap the higher score, in the order of their places: one that gave way comes back if what it gave way to gives way in turn."""
    zero = F.struct(_none(_FOUND).alias("kept"), _none(_FOUND).alias("gone"))

    def fold(state, c):
        last, gone = F.get(state["kept"], F.size(state["kept"]) - 1), F.get(state["gone"], 0)
        meets = F.coalesce(last["end"] > c["start"], F.lit(False))
        returns = F.coalesce(gone["end"] <= c["start"], F.lit(False))
        before = F.when(F.size(state["kept"]) > 1, F.slice(state["kept"], 1, F.greatest(F.size(state["kept"]) - 1, F.lit(1)))).otherwise(_none(_FOUND))
        swapped = F.concat(before, F.when(returns, state["gone"]).otherwise(_none(_FOUND)), F.array(c))
        kept = F.when(~meets, F.concat(state["kept"], F.array(c))).when(c["score"] > last["score"], swapped).otherwise(state["kept"])
        return F.struct(kept.alias("kept"), F.when(meets & (c["score"] > last["score"]), F.array(last)).when(meets, state["gone"]).otherwise(_none(_FOUND)).alias("gone"))

    return F.aggregate(F.array_sort(candidates), zero, fold, lambda d: d["kept"])


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs and `__base`, `__added`: arrays of (start, rank, end, span), rank the place of the kind in ALL_KINDS.

    Base matches are leftmost and non-overlapping for each kind; added spans overlap no base span and no other added one.
    Null texts are empty. Repeated rows are rows of their own. No shuffle.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    gates = {"email": body.contains("@"), "ip": body.rlike(r"[0-9]\.[0-9]"), "card": body.rlike(r"[0-9][\x20-]?[0-9]"), "phone": body.contains("+")}
    out = docs
    for rank, kind in enumerate(KINDS):
        out = out.withColumn(f"__{kind}", F.when(gates[kind], F.filter(_spans(body, BASE[kind], rank), holds_for(kind))).otherwise(_none()))
    out = out.withColumn("__base", F.array_sort(F.concat(*[F.col(f"__{k}") for k in KINDS])))
    candidates = F.concat(*[F.when(body.rlike(gate), _scored(body, kind, pattern)).otherwise(_none(_FOUND)) for kind, pattern, gate in GENERATORS])
    out = out.withColumn("__candidates", F.when(body.rlike(CANDIDATE_GATE), candidates).otherwise(_none(_FOUND)))
    clear = F.filter("__candidates", lambda c: ~F.exists("__base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    out = out.withColumn("__clear", F.when(F.size("__candidates") > 0, clear).otherwise(_none(_FOUND)))
    added = F.transform(_best(F.col("__clear")), lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), c["span"].alias("span")))
    out = out.withColumn("__added", F.when(F.size("__clear") > 0, added).otherwise(_none()))
    return out.drop("__candidates", "__clear", *[f"__{k}" for k in KINDS])


def _kind(span: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ALL_KINDS)), span["rank"] + 1)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone of the base spans, base_sha256, all spans as kind:start:end, and their number n_private."""
    found = find(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    count = lambda rank: F.size(F.filter("__base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        F.col("key").alias(key),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("__base", "__added"))).alias("spans"),
        (F.size("__base") + F.size("__added")).cast("long").alias("n_private"),
    )


#: Spans that are cut out of one stretch of a text together.
REDACT_BLOCK = 64


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of `text` put as [KIND]; spans that overlap are covered from the first start to the last end, as the first one's kind. Null stays null."""
    found = find(docs, text)
    merged = "array<struct<start:int,rank:int,end:int>>"

    def fold(done, s):
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["start"].alias("start"), last["rank"].alias("rank"), F.greatest(last["end"], s["end"]).alias("end"))
        before = F.when(F.size(done) > 1, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(_none(merged))
        meets = F.coalesce(last["end"] > s["start"], F.lit(False))
        return F.when(meets, F.concat(before, F.array(joined))).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))))

    found = found.withColumn("__cuts", F.aggregate(F.array_sort(F.concat("__base", "__added")), _none(merged), fold))
    label = lambda s: F.concat(F.lit("["), F.upper(_kind(s)), F.lit("]"))
    whole, cuts = F.col(text), F.col("__cuts")

    def block(b):
        mine = F.slice(cuts, b * REDACT_BLOCK + 1, F.lit(REDACT_BLOCK))
        start = F.coalesce(F.get(cuts, b * REDACT_BLOCK - 1)["end"], F.lit(0))
        end = F.get(mine, F.size(mine) - 1)["end"]

        def put(part):
            piece = lambda s, i: F.concat(F.substring(part["text"], F.coalesce(F.get(mine, i - 1)["end"], start) - start + 1, s["start"] - F.coalesce(F.get(mine, i - 1)["end"], start)), label(s))
            return F.array_join(F.transform(mine, piece), "")

        return F.get(F.transform(F.array(F.struct(F.substring(whole, start + 1, end - start).alias("text"))), put), 0)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / REDACT_BLOCK).cast("int")), block)
    last = F.get(cuts, F.size(cuts) - 1)["end"]
    changed = F.concat(F.array_join(blocks, ""), F.substring(whole, last + 1, F.length(whole)))
    return found.withColumn(text, F.when(F.size("__cuts") > 0, changed).otherwise(whole)).drop("__base", "__added", "__cuts")
