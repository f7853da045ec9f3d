"""Relational reasoning: solving, rendering, parsing and generating examples over the relations > < =.

Premises are array<struct<s,rel,o>>: "s rel o". An example's query is struct<x,y>. An example is small, so its graph is walked inside its row: no joins, no shuffles.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.functions.scores import char_similarity, first_sentence, let
from corpuslab.operators.dedup import first_of
from corpuslab.operators.select import balanced, choice
from corpuslab.profiles import ASSAMESE, HINDI, SPACE, ScriptProfile
from corpuslab.session import ship
from corpuslab.tables import drop_table, written


@dataclass(frozen=True)
class Language:
    """The sentences of a language: {A}, {B} stand for names and {attr} for what is compared."""

    profile: ScriptProfile
    prefix: str
    said: dict[str, str]
    denied: dict[str, str]
    asked: dict[str, str]
    marker: str
    attributes: tuple[str, ...]
    both: str
    so: str
    reason: str
    tells: str
    asks: str
    intro: tuple[str, str]
    compared: str
    equated: str
    more: str
    words: tuple[str, ...]


# The sentences of each language by relation, the words of rationales and framings, patterns that read sentences back (names, the comparing word, a denial), and words
# that no name may be.
LANGUAGES = {
    "hindi": Language(
        HINDI, "hin",
        said={">": "{A} की {attr} {B} की {attr} से अधिक है", "<": "{A} की {attr} {B} की {attr} से कम है", "=": "{A} की {attr} {B} की {attr} के बराबर है"},
        denied={">": "{A} की {attr} {B} की {attr} से अधिक नहीं है", "<": "{A} की {attr} {B} की {attr} से कम नहीं है", "=": "{A} की {attr} {B} की {attr} के बराबर नहीं है"},
        asked={">": "क्या {A} की {attr} {B} की {attr} से अधिक है?", "<": "क्या {A} की {attr} {B} की {attr} से कम है?", "=": "क्या {A} की {attr} {B} की {attr} के बराबर है?"},
        marker="क्या", attributes=("उम्र", "लंबाई", "बचत"), both=" और ", so=" इसलिए ", reason="कारण", tells=" ने कहा कि ", asks=" ने पूछा कि ", intro=("एक गाँव में ", " रहते हैं। "),
        compared="([^{S}।:?]+) की [^{S}]+ ([^{S}।:?]+) की [^{S}]+ से (अधिक|कम) (नहीं )?है", equated="([^{S}।:?]+) की [^{S}]+ ([^{S}।:?]+) की [^{S}]+ के बराबर (नहीं )?है", more="अधिक",
        words=("कम", "अधिक", "बराबर", "नहीं", "और", "कहा", "पूछा", "गाँव", "एक", "इसलिए", "कारण"),
    ),
    "assamese": Language(
        ASSAMESE, "asm",
        said={">": "{A}ৰ {attr} {B}ৰ {attr}তকৈ বেছি", "<": "{A}ৰ {attr} {B}ৰ {attr}তকৈ কম", "=": "{A}ৰ {attr} {B}ৰ {attr}ৰ সমান"},
        denied={">": "{A}ৰ {attr} {B}ৰ {attr}তকৈ বেছি নহয়", "<": "{A}ৰ {attr} {B}ৰ {attr}তকৈ কম নহয়", "=": "{A}ৰ {attr} {B}ৰ {attr}ৰ সমান নহয়"},
        asked={">": "কি {A}ৰ {attr} {B}ৰ {attr}তকৈ বেছি?", "<": "কি {A}ৰ {attr} {B}ৰ {attr}তকৈ কম?", "=": "কি {A}ৰ {attr} {B}ৰ {attr}ৰ সমান?"},
        marker=" কি ", attributes=("বয়স", "উচ্চতা", "সঞ্চয়"), both=" আৰু ", so=" সেয়ে ", reason="কাৰণ", tells=" কলে যে ", asks=" সুধিলে যে ", intro=("এখন গাঁৱত ", " থাকে। "),
        compared="([^{S}।?]+)ৰ [^{S}]+ ([^{S}।?]+)ৰ [^{S}]+তকৈ (বেছি|কম)( নহয়)?", equated="([^{S}।?]+)ৰ [^{S}]+ ([^{S}।?]+)ৰ [^{S}]+ৰ সমান( নহয়)?", more="বেছি",
        words=("কম", "বেছি", "সমান", "নহয়", "আৰু", "কলে", "সুধিলে", "যে", "কি", "এখন", "গাঁৱত", "থাকে", "সেয়ে", "কাৰণ"),
    ),
}
OPPOSITE = {">": "<", "<": ">", "=": "="}
STOP = "।"
#: Weights of the relation that a question asks about, most names that an introduction lists, and paradigms of examples.
QUESTION_WEIGHTS = {">": 0.4, "<": 0.4, "=": 0.2}
LISTED = 40
TRAINED, EVALUATED = ("transitive", "word_problem", "conversational"), ("transitive", "word_problem", "conversational", "multi_hop", "negation")


# ---------------------------------------------------------------- solving


def _reached(edges: Column, start: Column) -> Column:
    """Names that can be reached over edges (array<struct<a,b>>), the start among them: each round goes on from what the last one found."""

    def walk(e: Column) -> Column:
        def further(s: Column, _: Column) -> Column:
            new = F.array_except(F.transform(F.filter(e, lambda x: F.array_contains(s["now"], x["a"])), lambda x: x["b"]), s["seen"])
            return F.when(F.size(s["now"]) == 0, s).otherwise(let(new, lambda n: F.struct(F.concat(s["seen"], n).alias("seen"), n.alias("now"))))

        return F.aggregate(F.sequence(F.lit(0), F.size(e)), F.struct(F.array(start).alias("seen"), F.array(start).alias("now")), further, lambda s: s["seen"])

    return let(edges, walk)


def _edges(premises: Column, strict: bool) -> Column:
    """Edges that equalities make, in both directions; if strict, also those from the greater to the less."""
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    same = F.filter(premises, lambda p: p["rel"] == "=")
    both = F.concat(F.transform(same, lambda p: pair(p["s"], p["o"])), F.transform(same, lambda p: pair(p["o"], p["s"])))
    if not strict:
        return both
    down = F.transform(F.filter(premises, lambda p: p["rel"].isin(">", "<")), lambda p: F.when(p["rel"] == ">", pair(p["s"], p["o"])).otherwise(pair(p["o"], p["s"])))
    return F.concat(both, down)


def answer_of(premises: Column, x: Column, y: Column) -> Column:
    """struct<relation, error> of x to y: names that equalities tie are equal, whatever else is said; then the one from which the other can be reached is greater.

    error: unknown entity, unknown relation, cycle (each can be reached from the other), underdetermined, or null.
    """
    names = F.flatten(F.transform(premises, lambda p: F.array(p["s"], p["o"])))
    known = F.array_contains(names, x) & F.array_contains(names, y)
    odd = F.exists(premises, lambda p: ~p["rel"].isin(">", "<", "="))

    def says(relation: str | None, error: str | None = None) -> Column:
        return F.struct(F.lit(relation).cast("string").alias("relation"), F.lit(error).cast("string").alias("error"))

    def over(a: Column, b: Column) -> Column:
        return let(_edges(premises, True), lambda e: F.array_contains(_reached(e, a), b))

    strict = let(F.struct(over(x, y).alias("there"), over(y, x).alias("back")), lambda r: F.when(r["there"] & r["back"], says(None, "cycle")).when(r["there"], says(">")).when(r["back"], says("<")).otherwise(says(None, "underdetermined")))
    return F.when(x == y, says("=")).when(~known, says(None, "unknown entity")).when(odd, says(None, "unknown relation")).when(F.array_contains(_reached(_edges(premises, False), x), y), says("=")).otherwise(strict)


def solved(examples: DataFrame) -> DataFrame:
    """examples (premises, query) with relation (of x to y; null if there is none) and error, as in answer_of()."""
    found = examples.withColumn("_answer", answer_of(F.col("premises"), F.col("query.x"), F.col("query.y")))
    return found.withColumn("relation", F.col("_answer.relation")).withColumn("error", F.col("_answer.error")).drop("_answer")


def hops_of(premises: Column, x: Column, y: Column) -> Column:
    """Premises on the shortest way between two names, in whichever direction they compare; the number of premises where there is none."""
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    edges = F.concat(F.transform(premises, lambda p: pair(p["s"], p["o"])), F.transform(premises, lambda p: pair(p["o"], p["s"])))

    def walk(e: Column) -> Column:
        def further(s: Column, i: Column) -> Column:
            new = F.array_except(F.transform(F.filter(e, lambda z: F.array_contains(s["now"], z["a"])), lambda z: z["b"]), s["seen"])
            state = lambda seen, now, d: F.struct(seen.alias("seen"), now.alias("now"), d.alias("d"))
            none = F.array().cast("array<string>")
            return F.when(F.size(s["now"]) == 0, s).when(F.array_contains(s["now"], y), state(s["seen"], none, i)).otherwise(let(new, lambda n: state(F.concat(s["seen"], n), n, F.lit(-1))))

        start = F.struct(F.array(x).alias("seen"), F.array(x).alias("now"), F.lit(-1).alias("d"))
        return F.aggregate(F.sequence(F.lit(0), F.size(e)), start, further, lambda s: s["d"])

    return let(let(edges, walk), lambda d: F.when(d < 0, F.size(premises)).otherwise(d))


def hops(examples: DataFrame) -> DataFrame:
    """(id, hops) of examples (id, premises, query)."""
    return examples.select("id", hops_of(F.col("premises"), F.col("query.x"), F.col("query.y")).alias("hops"))


def up_to_hops(examples: DataFrame, most: int | None) -> DataFrame:
    """The examples whose query is at most so many premises long, all of them without a limit. Raises if none is left."""
    kept = examples if most is None else examples.where(hops_of(F.col("premises"), F.col("query.x"), F.col("query.y")) <= most)
    if kept.limit(1).count() == 0:
        raise ValueError(f"no example has {most} hops or fewer")
    return kept


# ---------------------------------------------------------------- rendering and parsing


def filled(template: str, a: Column, b: Column, attribute: Column) -> Column:
    return F.replace(F.replace(F.replace(F.lit(template), F.lit("{A}"), a), F.lit("{B}"), b), F.lit("{attr}"), attribute)


def sentence(a: Column, rel: Column, b: Column, attribute: Column, negate: Column, language: str = "hindi") -> Column:
    """A premise or an answer; negated, it denies the opposite relation."""
    spec, out = LANGUAGES[language], None
    for r in "<=>":
        said = F.when(negate, filled(spec.denied[OPPOSITE[r]], a, b, attribute)).otherwise(filled(spec.said[r], a, b, attribute))
        out = F.when(rel == r, said) if out is None else out.when(rel == r, said)
    return F.concat(out, F.lit(STOP))


def question(a: Column, rel: Column, b: Column, attribute: Column, language: str = "hindi") -> Column:
    out = None
    for r, asked in LANGUAGES[language].asked.items():
        out = F.when(rel == r, filled(asked, a, b, attribute)) if out is None else out.when(rel == r, filled(asked, a, b, attribute))
    return out


def rendered(premises: Column, query: Column, attribute: Column, paradigm: Column, asked: Column, entities: Column, language: str = "hindi", own_attributes: bool = False) -> Column:
    """The text of an example in its paradigm. own_attributes: premises say what they compare themselves (struct<s,rel,o,attr>)."""
    spec, negate = LANGUAGES[language], paradigm == "negation"
    say = lambda p: sentence(p["s"], p["rel"], p["o"], p["attr"] if own_attributes else attribute, negate, language)
    q = question(query["x"], asked, query["y"], attribute, language)
    spoken = F.transform(premises, lambda p, i: F.concat(F.when(i % 2 == 0, p["s"]).otherwise(p["o"]), F.lit(spec.tells), say(p)))
    before, after = spec.intro
    intro = F.when((paradigm == "word_problem") & (F.size(entities) <= LISTED), F.concat(F.lit(before), F.array_join(entities, spec.both), F.lit(after))).otherwise("")
    plain = F.concat(intro, F.array_join(F.transform(premises, say), " "), F.lit(" "), q)
    return F.when(paradigm == "conversational", F.concat_ws(" ", F.array_join(spoken, " "), F.concat(query["x"], F.lit(spec.asks), q))).otherwise(plain)


def comparisons(text: Column, language: str = "hindi") -> Column:
    """array<struct<s,rel,o>> of the sentences of a text: those that compare, then those that equate. A denied comparison says the opposite; a denied equality has no rel."""
    spec = LANGUAGES[language]

    def groups(pattern: str, *names: str) -> Column:
        p = F.lit(pattern.replace("{S}", SPACE))
        return F.arrays_zip(*(F.regexp_extract_all(text, p, F.lit(i + 1)).alias(n) for i, n in enumerate(names)))

    denied = lambda z: F.trim(z["n"]) != ""
    one = lambda z, rel: F.struct(z["s"].alias("s"), rel.alias("rel"), z["o"].alias("o"))
    ordered = F.transform(groups(spec.compared, "s", "o", "r", "n"), lambda z: one(z, F.when((z["r"] == spec.more) != denied(z), ">").otherwise("<")))
    equal = F.transform(groups(spec.equated, "s", "o", "n"), lambda z: one(z, F.when(~denied(z), F.lit("="))))
    return F.concat(ordered, equal)


def parsed(text: Column, language: str = "hindi") -> Column:
    """Premises read back from a rendered text, before its question: those that compare, then those that equate. Null if an equality is denied: it does not say who has more."""
    before = F.substring_index(text, LANGUAGES[language].marker, 1)
    return let(comparisons(before, language), lambda c: F.when(F.exists(c, lambda p: p["rel"].isNull()), F.lit(None)).otherwise(c))


#: The order in which renderings of an answer are tried, as the relation that is said, whether its opposite is denied, and whether the names are swapped.
RENDERINGS = (
    ("<", False, False), ("<", False, True), ("<", True, False), ("<", True, True),
    ("=", False, False), ("=", False, True), ("=", True, False), ("=", True, True),
    (">", False, False), (">", False, True), (">", True, False), (">", True, True),
)


def asserted(rows: DataFrame, least: float = 0.8, language: str = "hindi") -> DataFrame:
    """rows (pred, query, attribute) with asserted: the relation of x to y that the prediction's first sentence is closest to, null if none is close.

    All renderings are compared inside the row; the earliest of equally close ones counts.
    """
    said, x, y = first_sentence(F.col("pred")), F.col("query.x"), F.col("query.y")
    tried = []
    for rel, negate, swapped in RENDERINGS:
        a, b = (y, x) if swapped else (x, y)
        likeness = char_similarity(said, sentence(a, F.lit(rel), b, F.col("attribute"), F.lit(negate), language))
        tried.append(F.struct(likeness.alias("sim"), F.lit(-len(tried)).alias("ord"), F.lit(OPPOSITE[rel] if swapped else rel).alias("rel")))
    best = F.array_max(F.array(*tried))
    return rows.withColumn("asserted", F.when((F.trim(said) != "") & (best["sim"] >= least), best["rel"]))


def asserted_by_pattern(rows: DataFrame, language: str = "hindi") -> DataFrame:
    """rows (pred, query) with asserted: the relation of x to y in the first sentence that names the pair in either order, those that compare before those that equate; null if none does."""
    x, y = F.col("query.x"), F.col("query.y")
    here = lambda p: ((p["s"] == x) & (p["o"] == y)) | ((p["s"] == y) & (p["o"] == x))
    first = F.get(F.filter(comparisons(F.col("pred"), language), lambda p: p["rel"].isNotNull() & here(p)), F.lit(0))
    turned = F.when(first["rel"] == ">", "<").when(first["rel"] == "<", ">").otherwise(first["rel"])
    return rows.withColumn("asserted", F.when(first["s"] == x, first["rel"]).otherwise(turned))


# ---------------------------------------------------------------- rationales


def path_of(premises: Column, x: Column, y: Column) -> Column:
    """Names from x to y along premises, null if there is no way: the way of a walk in depth that goes on from the name seen last."""
    none = F.array().cast("array<string>")

    def further(s: Column, _: Column) -> Column:
        here = F.element_at(s["stack"], -1)
        beside = F.flatten(F.transform(premises, lambda p: F.concat(F.when(p["s"] == here, F.array(p["o"])).otherwise(none), F.when(p["o"] == here, F.array(p["s"])).otherwise(none))))
        on = lambda n: F.struct(
            F.concat(F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1), n).alias("stack"), F.concat(s["seen"], n).alias("seen"), F.concat(s["from"], F.array_repeat(here, F.size(n))).alias("from")
        )
        return F.when(F.size(s["stack"]) == 0, s).otherwise(let(F.array_except(beside, s["seen"]), on))

    def back(s: Column) -> Column:
        step = lambda p, _: F.when(p[0] == x, p).otherwise(F.concat(F.array(F.get(s["from"], F.array_position(s["seen"], p[0]).cast("int") - 1)), p))
        return F.when(F.array_contains(s["seen"], y), F.aggregate(s["seen"], F.array(y), step))

    start = F.struct(F.array(x).alias("stack"), F.array(x).alias("seen"), F.array(x).alias("from"))
    return F.aggregate(F.sequence(F.lit(0), F.size(premises) * 2), start, further, back)


def rationale_of(premises: Column, query: Column, language: str = "hindi") -> Column:
    """The steps along the way from the query's first name to its second, each with its relation, and the relation that they imply; null without one."""
    spec = LANGUAGES[language]

    def said(way: Column) -> Column:
        steps = F.transform(F.slice(way, F.lit(1), F.greatest(F.size(way) - 1, F.lit(0))), lambda u, i: F.concat_ws(" ", u, answer_of(premises, u, F.get(way, i + 1))["relation"], F.get(way, i + 1)))
        so = F.concat(query["x"], F.lit(" "), answer_of(premises, query["x"], query["y"])["relation"], F.lit(" "), query["y"])
        return F.concat(F.lit(f"[{spec.reason}: "), F.array_join(steps, spec.both), F.lit(spec.so), so, F.lit("]"))

    return let(path_of(premises, query["x"], query["y"]), said)


def rationales(examples: DataFrame, language: str = "hindi") -> DataFrame:
    """examples (premises, query) that have a relation, with rationale."""
    return examples.withColumn("rationale", rationale_of(F.col("premises"), F.col("query"), language)).where("rationale is not null")


# ---------------------------------------------------------------- names


def syllables(profile: ScriptProfile) -> tuple[list[str], list[str], list[str], list[str]]:
    """First vowels, consonants, joined consonants and vowel signs of a script, by their places in its block: letters that begin no name are left out."""
    import unicodedata

    def letters(first: int, last: int, *out: str) -> list[str]:
        found = ((chr(c), unicodedata.name(chr(c), "")) for c in range(profile.first + first, profile.first + last))
        return [c for c, name in found if name and name.split()[-1] not in out]

    vowels = [v for v in letters(0x05, 0x15, "L", "R", "E", "O") if " SHORT " not in unicodedata.name(v)]
    consonants = letters(0x15, 0x3A, "NGA", "NYA", "NNA", "NNNA", "RRA", "LLA", "LLLA")
    if profile is ASSAMESE:
        consonants = [c for c in consonants if c != "র"] + ["ৰ", "ৱ"]
    halant = chr(profile.first + 0x4D)
    joined = [a + halant + b for a in consonants for b in consonants if a != b and b in consonants[-9:-4]]
    return vowels, consonants, joined, ["", "", *letters(0x3E, 0x43), *letters(0x47, 0x48), *letters(0x4B, 0x4C), chr(profile.first + 0x02)]


class FreshNames:
    """Names of two to four syllables and 3 to 14 characters, drawn anew for each example, none of them excluded or a word of the sentences."""

    def __init__(self, language: str, excluded: frozenset[str] = frozenset()) -> None:
        spec = LANGUAGES[language]
        self.vowels, self.consonants, self.joined, self.signs = syllables(spec.profile)
        self.excluded = excluded.union(spec.words)

    def one(self, rng: random.Random) -> str:
        while True:
            parts = [rng.choice(self.joined if rng.random() < 0.3 else self.consonants) + rng.choice(self.signs) for _ in range(rng.choice((2, 2, 3, 3, 4)))]
            if rng.random() < 0.2:
                parts[0] = rng.choice(self.vowels)
            if rng.random() < 0.6:
                parts.append(rng.choice(self.consonants))
            name = "".join(parts)
            if 3 <= len(name) <= 14 and name not in self.excluded:
                return name

    def some(self, rng: random.Random, k: int) -> list[str]:
        found: dict[str, None] = {}
        while len(found) < k:
            found.setdefault(self.one(rng))
        return list(found)


def synthetic_names(spark: SparkSession, onsets: list[str], middles: list[str], endings: list[str], excluded: DataFrame) -> DataFrame:
    """(name): all combinations of syllables less the excluded names. The lists are short, so their product is."""
    a, b, c = (spark.createDataFrame([(x,) for x in xs], f"{n} string") for n, xs in (("a", onsets), ("b", middles), ("c", endings)))
    return a.crossJoin(b).crossJoin(c).select(F.concat("a", "b", "c").alias("name")).distinct().join(excluded.select("name"), "name", "left_anti")


def all_names(*pools: DataFrame) -> DataFrame:
    """(name) of several tables of names, each once."""
    out = pools[0].select("name")
    for p in pools[1:]:
        out = out.union(p.select("name"))
    return out.distinct()


def mixed_names(rng: random.Random, names: list[str], real: list[str], share: float) -> list[str]:
    """Each name with a chance `share` replaced by a real one; no name comes twice."""
    out: list[str] = []
    for name in names:
        other = rng.choice(real) if real and rng.random() < share else name
        out.append(name if other in out or other in names else other)
    return out


# ---------------------------------------------------------------- generating

PREMISE = "struct<s: string, rel: string, o: string>"
STATED = "struct<s: string, rel: string, o: string, attr: string>"
EXAMPLE = (
    f"id string, paradigm string, attribute string, entities array<string>, premises array<{PREMISE}>, query struct<x: string, y: string>, answer_rel string, question_rel string, hops int, "
    f"stated array<{STATED}>, distractors array<{STATED}>, number long"
)

DRAWN = ["id", "paradigm", "attribute", "entities", "premises", "query", "answer_rel", "question_rel", "hops", "stated", "distractors", "number"]


def _either(rng: random.Random, s: str, rel: str, o: str) -> tuple[str, str, str]:
    """A premise, said in one of its two directions."""
    return (s, rel, o) if rng.random() < 0.5 else (o, OPPOSITE[rel], s)


def chain(rng: random.Random, who: list[str], gap: int, wanted: str | None, ties: float = 0.15) -> tuple[list[tuple[str, str, str]], str, str, str]:
    """Premises between neighbours of an order of names (the greater first), each said in a random direction, shuffled; and a query, `gap` premises apart, with its relation: the wanted one if there is one."""
    size = len(who)
    tied = [rng.random() < ties for _ in range(size - 1)]
    a = rng.randrange(0, size - gap)
    if wanted == "=":
        tied[a : a + gap] = [True] * gap
    elif wanted and all(tied[a : a + gap]):
        tied[rng.randrange(a, a + gap)] = False
    rel = "=" if all(tied[a : a + gap]) else wanted or rng.choice("<>")
    said = [_either(rng, x, "=" if tie else ">", y) for x, y, tie in zip(who, who[1:], tied, strict=False)]
    rng.shuffle(said)
    first = rel == ">" or (rel == "=" and rng.random() < 0.5)
    return said, who[a if first else a + gap], who[a + gap if first else a], rel


def branches(rng: random.Random, who: list[str], more: list[str], equal: bool) -> list[tuple[str, str, str]]:
    """A premise for each further name that hangs it on one that is there: the graph stays a tree, and the answer does not need them."""
    there, out = list(who), []
    for x in more:
        out.append(_either(rng, x, rng.choice("<>=" if equal else "<>"), rng.choice(there)))
        there.append(x)
    return out


def shortcuts(rng: random.Random, who: list[str], premises: list[tuple[str, str, str]], query: tuple[str, str], n: int) -> list[tuple[str, str, str]]:
    """At most n true premises between names of a chain that no premise links yet, other than the query's own."""
    said = {frozenset((s, o)): (s, r) for s, r, o in premises}
    same = [said[frozenset(p)][1] == "=" for p in zip(who, who[1:], strict=False)]
    free = [(i, j) for i in range(len(who)) for j in range(i + 1, len(who)) if frozenset((who[i], who[j])) not in said and {who[i], who[j]} != set(query)]
    return [_either(rng, who[i], "=" if all(same[i:j]) else ">", who[j]) for i, j in rng.sample(free, min(n, len(free)))]


def distractors(rng: random.Random, who: list[str], attribute: str, attributes: tuple[str, ...], n: int) -> list[tuple[str, str, str, str]]:
    """At most n premises, without ties, between the same names about another attribute."""
    other, order = rng.choice([a for a in attributes if a != attribute]), rng.sample(who, len(who))
    some = rng.sample(list(zip(order, order[1:], strict=False)), min(n, len(order) - 1))
    return [(*_either(rng, x, ">", y), other) for x, y in some]


#: Fixed value: tries for each example that is asked for.
MOST_TRIES = 50


def generate(
    spark: SparkSession, n: int, names: list[str], seed: int, paradigms: dict[str, float] | None = None, sizes: tuple[int, ...] = (3, 4, 5), least_hops: int = 1, partitions: int | None = None, *,
    language: str = "hindi", split: str = "", exact_hops: int | None = None, multi_hops: int = 2, long_share: float = 0.0, balance: bool = True, branched: int = 0, shortened: int = 0, distracted: int = 0,
    fresh: bool = False, excluded: list[str] | None = None, real: list[str] | None = None, real_share: float = 0.0,
) -> DataFrame:
    """n examples as a written table, no text twice: chains with a query at least least_hops apart, or exact_hops. Raises if the names do not give as many different texts in MOST_TRIES tries for each.

    multi_hop queries are at least multi_hops apart. long_share: of queries that are at least two premises apart whatever least_hops says. balance: answers have equal shares of the relations; denials are never about
    equalities, as a denied equality would not say which is more. branched, shortened, distracted: further premises that the answer does not need (branches(), shortcuts(), distractors()).
    fresh: names are drawn for each example (FreshNames) and not from `names`, never an excluded one; with the chance real_share a name is a real one. multi_hop chains have a name more.
    Tries are numbered, and each draws from a stream of its own, so that the result does not depend on how tries are dealt out.
    """
    weights, spec = paradigms or dict.fromkeys(TRAINED, 1.0), LANGUAGES[language]
    maker = FreshNames(language, frozenset(excluded or [])) if fresh else None
    ship(spark)

    def example(i: int) -> tuple:
        rng = random.Random(f"{seed}:{i}")
        paradigm = rng.choices(list(weights), list(weights.values()))[0]
        denied = paradigm == "negation"
        several = paradigm == "multi_hop"
        size = rng.choice(sizes) + (several and exact_hops is None)
        who = maker.some(rng, size + branched) if maker else rng.sample(names, size + branched)
        if maker:
            who = mixed_names(rng, who, real or [], real_share)
        who, more = who[:size], who[size:]
        least = max(2 if rng.random() < long_share else 1, multi_hops if several else least_hops)
        gap = exact_hops if exact_hops is not None else rng.randint(min(least, size - 1), size - 1)
        wanted = ("<>"[i // 3 % 2] if denied and i % 3 == 2 else "<>="[i % 3]) if balance else rng.choice("<>") if denied else None
        said, x, y, rel = chain(rng, who, gap, wanted, 0.0 if denied else 0.15)
        attribute = rng.choice(spec.attributes)
        said = said + branches(rng, who, more, not denied) + (shortcuts(rng, who, said, (x, y), shortened) if shortened else [])
        others = distractors(rng, who, attribute, spec.attributes, distracted) if distracted else []
        stated = [(*p, attribute) for p in said] + others
        if len(stated) >= size:  # more than the chain's own premises
            rng.shuffle(stated)
        row = lambda p: dict(zip(("s", "rel", "o", "attr"), p, strict=False))
        return ("", paradigm, attribute, [*who, *more], [row(p) for p in said], {"x": x, "y": y}, f"{x} {rel} {y}", "", gap, [row(p) for p in stated], [row(p) for p in others], i)

    def tries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([example(int(i)) for i in batch["i"]], columns=DRAWN)

    prefix = f"{spec.prefix}_{split}_" if split else f"{seed}-"
    rel = F.split("answer_rel", " ")[1]
    order = [F.col("number")]
    for each in (2, 10, MOST_TRIES):
        made = spark.range(0, each * n + 60, 1, partitions or spark.sparkContext.defaultParallelism).withColumnRenamed("id", "i").mapInPandas(tries, EXAMPLE)
        made = made.withColumn("id", F.concat(F.lit(prefix), F.col("number").cast("string"))).withColumn("question_rel", choice(F.concat_ws("-", F.lit(seed), "number"), seed + 2, QUESTION_WEIGHTS))
        text = rendered(F.col("stated"), F.col("query"), F.col("attribute"), F.col("paradigm"), F.col("question_rel"), F.col("entities"), language, own_attributes=True)
        answer = sentence(F.col("query.x"), rel, F.col("query.y"), F.col("attribute"), F.col("paradigm") == "negation", language)
        made = made.withColumn("text", text).withColumn("relation", rel).withColumn("answer_text", answer)
        one = first_of(made, F.col("text"), order)
        found, at = written((balanced(one, "relation", order, n) if balance else one).orderBy("number").limit(n).drop("stated"), "examples")
        if found.count() == n:
            return found
        drop_table(spark, at)
    raise ValueError(f"the names do not give {n} different texts in {MOST_TRIES * n} tries")


def with_rationale(examples: DataFrame, language: str = "hindi") -> DataFrame:
    """examples with cot_text: the rationale and the answer."""
    return examples.withColumn("cot_text", F.concat_ws(" ", rationale_of(F.col("premises"), F.col("query"), language), "answer_text"))


#: Share of denials in training, hops of the ordinary and of the hard depth tests, further premises of hard tests, hops and size of a bank of questions.
DENIED_SHARE, DEPTHS, HARD_DEPTHS, FURTHER, BANK_HOPS, BANK_SIZE = 0.05, (2, 3, 4, 5), (6, 8, 10), 3, (2, 3, 4, 5, 6, 8, 10), 40


def dataset(
    spark: SparkSession, sizes: dict[str, int], names: dict[str, list[str]], seed: int = 1337, language: str = "hindi", fresh: bool = False, real_share: float = 0.0, extra: int = 0, hard: int = 0,
) -> dict[str, DataFrame]:
    """Examples by split: train, val and test, each with names of its own (sizes, names: by split; names that two splits share raise).

    train has denials in a share of DENIED_SHARE and no multi_hop. extra: size of further tests: balanced, by depth, and a val with names of training's kind; hard: of deep chains,
    and of chains with premises that the answer does not need.
    """
    pools = [set(names[s]) for s in ("train", "val", "test")]
    if any(a & b for i, a in enumerate(pools) for b in pools[:i]):
        raise ValueError("splits share names")
    held = sorted(pools[1] | pools[2])
    kind = {"language": language, "balance": False}
    trained = {"fresh": fresh, "excluded": held, "real": names["train"], "real_share": real_share}
    every = dict.fromkeys(EVALUATED, 1.0)
    share = (1 - DENIED_SHARE) / len(TRAINED)

    def test(name: str, n: int, at: int, pool: str = "test", **more) -> DataFrame:
        return generate(spark, n, names[pool], seed + at, every, more.pop("sizes", (3, 4)), split=name, **(kind | more))

    def deep(name: str, n: int, at: int, depth: int, **more) -> DataFrame:
        return test(name, n, at, sizes=(depth + 1,), exact_hops=depth, **more)

    out = {
        "train": generate(spark, sizes["train"], names["train"], seed, dict.fromkeys(TRAINED, share) | {"negation": DENIED_SHARE}, (3, 4), 1, split="train", long_share=0.5, **kind, **trained),
        "val": test("val", sizes["val"], 1, "val"),
        "test": test("test", sizes["test"], 2),
    }
    if extra:
        out["test_balanced"] = test("test_balanced", extra, 3, balance=True)
        out |= {f"test_depth{d}": deep(f"test_depth{d}", extra, 10 + d, d) for d in DEPTHS}
        out["val_train_names"] = test("val_train_names", extra, 20, "train", **trained)
    if hard:
        out |= {f"test_depth{d}": deep(f"test_depth{d}", hard, 30 + d, d) for d in HARD_DEPTHS}
        out["test_branch"] = deep("test_branch", hard, 50, 3, branched=FURTHER)
        out["test_distractor_attr"] = deep("test_distractor_attr", hard, 51, 3, distracted=FURTHER)
        out["test_redundant"] = deep("test_redundant", hard, 52, 4, shortened=FURTHER)
    return {name: with_rationale(df.withColumn("split", F.lit(name)), language) for name, df in out.items()}


def question_bank(spark: SparkSession, names: list[str], seed: int = 2026, language: str = "hindi", depths: tuple[int, ...] = BANK_HOPS, each: int = BANK_SIZE) -> DataFrame:
    """(hops, text, query, answer, relation, paradigm): as many questions of every paradigm for each number of hops."""
    out = None
    for d in depths:
        rows = generate(spark, each, names, seed * 100 + d, dict.fromkeys(EVALUATED, 1.0), (d + 1,), exact_hops=d, language=language, balance=False)
        rows = rows.select(F.lit(d).alias("hops"), "text", "query", F.col("answer_text").alias("answer"), "relation", "paradigm")
        out = rows if out is None else out.unionByName(rows)
    return out
