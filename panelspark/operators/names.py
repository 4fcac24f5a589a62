"""One name for each person of a set of rolls: who shares a surname is judged over all rolls, who a bare surname is within one.

Rolls are rows (meeting, side, place, name), side being "present" or "absent"; one person presides over a meeting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Titles that go before a name.
HONORIFIC = r"^(?:(?:commissioner|president|vice[- ]president|chair|mr|mrs|ms|dr|hon)\.?\s+)+"


def parts(name: Column) -> Column:
    """The words of a name without titles, without last words that hold no letter, a hyphenated last word as two."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), f"(?i){HONORIFIC}", "")
    plain = F.regexp_replace(plain, r"^(\S+(?: \S+)*?)(?: [^A-Za-z\s]+)+$", "$1")
    plain = F.regexp_replace(plain, r"-(?=[^\s-]*$)", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def people(rolls: DataFrame) -> DataFrame:
    """(surname, initial, person, n, full, shared): what all rolls say of each initial of a surname.

    Initials of a surname are one person where a printed full form ends another's ("Bradford Bell" and "Shelley Bradford
    Bell"), as connected components of that evidence; person is the least initial of a component. A surname is shared if
    two of its persons have an initial that is printed twice: one printing may be a slip. full is the component's most
    frequent form with a given name, the smallest of ties.
    """
    words = parts(F.col("name"))
    said = rolls.where("name is not null").select(words.alias("w")).where("size(w) > 1")
    said = said.select(F.lower(F.try_element_at("w", F.lit(-1))).alias("surname"), F.upper(F.substring(F.get("w", F.lit(0)), 1, 1)).alias("initial"), F.array_join("w", " ").alias("form"), (F.length(F.regexp_replace(F.get("w", F.lit(0)), r"\.", "")) > 1).alias("given")).where(F.col("initial").rlike(r"\p{L}"))
    forms = said.groupBy("surname", "initial", "form", "given").agg(F.count("*").alias("n"))
    initials = forms.groupBy("surname", "initial").agg(F.sum("n").alias("n"))
    # Every ending of a form is looked up, so forms meet by an equi join and not in pairs.
    full = forms.where("given")
    w = F.split("form", " ")
    endings = full.select("surname", "initial", F.explode(F.transform(F.sequence(F.lit(2), F.size(w)), lambda i: F.lower(F.array_join(F.slice(w, i, F.size(w)), " ")))).alias("ending"))
    links = endings.join(full.select("surname", F.col("initial").alias("short"), F.lower("form").alias("ending")), ["surname", "ending"]).where("initial <> short").select("surname", "initial", "short").distinct()
    # A surname has few initials: its links are folded one by one into the least initial that they reach.
    edges = links.groupBy("surname").agg(F.array_sort(F.collect_list(F.struct(F.col("initial").alias("a"), F.col("short").alias("b")))).alias("e"))
    nodes = initials.groupBy("surname").agg(F.array_sort(F.collect_list(F.struct("initial", F.col("initial").alias("person")))).alias("nodes"))

    def joined(state: Column, e: Column) -> Column:
        person = lambda x: F.get(F.filter(state, lambda s: s["initial"] == x), F.lit(0))["person"]
        low, high = F.least(person(e["a"]), person(e["b"])), F.greatest(person(e["a"]), person(e["b"]))
        return F.transform(state, lambda s: F.struct(s["initial"].alias("initial"), F.when(s["person"] == high, low).otherwise(s["person"]).alias("person")))

    none = F.array().cast("array<struct<a:string,b:string>>")
    found = nodes.join(edges, "surname", "left").select("surname", F.explode(F.aggregate(F.coalesce("e", none), F.col("nodes"), joined)).alias("p")).select("surname", "p.initial", "p.person")
    known = initials.join(found, ["surname", "initial"])
    shared = known.where("n > 1").groupBy("surname").agg((F.countDistinct("person") > 1).alias("shared"))
    best = full.join(found, ["surname", "initial"]).groupBy("surname", "person", "form").agg(F.sum("n").alias("n")).groupBy("surname", "person").agg(F.min_by("form", F.struct(-F.col("n"), F.col("form"))).alias("full"))
    return known.join(best, ["surname", "person"], "left").join(shared, "surname", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))


def reduced(df: DataFrame, name: str, known: DataFrame, out: str) -> DataFrame:
    """df with `out`: the surname; where it is shared, the person's full form, else the name as printed. Null where no letter is left."""
    words = parts(F.col(name))
    held = df.withColumn("__w", words).withColumn("__sur", F.lower(F.try_element_at("__w", F.lit(-1)))).withColumn("__ini", F.when(F.size("__w") > 1, F.upper(F.substring(F.get("__w", F.lit(0)), 1, 1))))
    of_initial = known.select(F.col("surname").alias("__sur"), F.col("initial").alias("__ini"), F.col("full").alias("__full"))
    of_surname = known.groupBy(F.col("surname").alias("__sur")).agg(F.max("shared").alias("__shared"))
    met = held.join(of_surname, "__sur", "left").join(of_initial, ["__sur", "__ini"], "left")
    last = F.try_element_at("__w", F.lit(-1))
    told = F.coalesce("__shared", F.lit(False)) & F.col("__ini").rlike(r"\p{L}")
    value = F.when(told, F.coalesce("__full", F.array_join("__w", " "))).otherwise(last)
    return met.withColumn(out, F.when(value.rlike(r"\p{L}"), value)).drop("__w", "__sur", "__ini", "__full", "__shared")


def settled(rolls: DataFrame, presiding: DataFrame) -> DataFrame:
    """(meeting, side, place, name, person) of rolls, presiding being (meeting, name): bare shared surnames are told apart where their meeting says enough.

    For a surname that exactly two persons share, the chair is who presides more often under a full name, the smaller of
    ties. Two bare printings on one side are both, the chair first. A bare one present at a meeting that a bearer of the
    surname presides over is the chair. If one of the two is named in the meeting, a bare one is the other. Else it stays bare.
    """
    known = people(rolls.select("name").unionByName(presiding.select("name")))
    named = reduced(rolls, "name", known, "person")
    chairs = reduced(presiding, "name", known, "chair").select("meeting", "chair")
    two = known.where("shared").groupBy("surname").agg(F.array_sort(F.collect_set(F.coalesce("full", F.concat_ws(" ", "person", "surname")))).alias("two")).where("size(two) = 2")
    led = two.select("surname", F.explode("two").alias("who")).join(chairs.groupBy(F.col("chair").alias("who")).agg(F.count("*").alias("times")), "who", "left").groupBy("surname").agg(F.min_by("who", F.struct(-F.coalesce("times", F.lit(0)), F.col("who"))).alias("led"))
    pairs = two.join(led.select("surname", "led"), "surname").select(F.col("surname").alias("__sur"), F.col("led").alias("__led"), F.get(F.filter("two", lambda x: x != F.col("led")), F.lit(0)).alias("__rest"))
    held = named.withColumn("__sur", F.lower(F.try_element_at(F.split("person", " "), F.lit(-1)))).withColumn("__bare", F.col("person").isNotNull() & ~F.col("person").contains(" "))
    held = held.join(pairs, "__sur", "left").withColumn("__bare", F.col("__bare") & F.col("__led").isNotNull())
    # What a meeting says of a surname, one row a meeting and surname.
    bare = lambda side: F.count_if(F.col("__bare") & (F.col("side") == side))
    says = held.where("__led is not null").groupBy("meeting", "__sur").agg(
        bare("present").alias("__present"), bare("absent").alias("__absent"), F.max((F.col("person") == F.col("__led")).cast("int")).alias("__has_led"), F.max((F.col("person") == F.col("__rest")).cast("int")).alias("__has_rest"),
        F.min(F.when(F.col("__bare") & (F.col("side") == "present"), F.col("place"))).alias("__p0"), F.min(F.when(F.col("__bare") & (F.col("side") == "absent"), F.col("place"))).alias("__a0"),
    )
    chaired = chairs.where("chair is not null").select("meeting", F.lower(F.try_element_at(F.split("chair", " "), F.lit(-1))).alias("__sur")).distinct().withColumn("__chaired", F.lit(True))
    met = held.join(says, ["meeting", "__sur"], "left").join(chaired, ["meeting", "__sur"], "left")
    both = F.when(F.col("side") == "present", F.col("__present")).otherwise(F.col("__absent")) == 2
    first = F.col("place") == F.when(F.col("side") == "present", F.col("__p0")).otherwise(F.col("__a0"))
    gavelled = (F.col("side") == "present") & F.coalesce("__chaired", F.lit(False))
    pair_named = (F.col("__present") == 2) | (F.col("__absent") == 2)
    one = (F.coalesce("__has_led", F.lit(0)) + F.coalesce("__has_rest", F.lit(0)) == 1) & ~pair_named
    person = F.when(~F.col("__bare"), F.col("person")).when(both, F.when(first, F.col("__led")).otherwise(F.col("__rest"))).when(gavelled, F.col("__led")).when(one, F.when(F.col("__has_led") == 1, F.col("__rest")).otherwise(F.col("__led"))).otherwise(F.col("person"))
    return met.select("meeting", "side", "place", "name", person.alias("person"))
