"""Personal data by bootstrapped contextual extraction: seeds, the contexts they stand in, and what else stands there. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring, the score from which a context counts as one of a kind, and the different seeds it needs at least.
ROUNDS, TRUST, SEEDS = 3, 0.75, 3
#: Characters on either side of a span from which its contexts are taken.
CONTEXT_CHARS = 48
#: Matches of a text whose places are summed up together; see `_spans`.
RUN = 256

#: Stands for a separator between two characters of one match, so that no pattern has to repeat a group over a long text.
_MARK, _SPARE = "\ue000", "\ue001"

#: What a text must have for a pattern to be tried, what is rewritten first (each character by one), and the pattern.
_BASE = {
    "email": (r"@", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", rf"(?:(?<![A-Za-z0-9._%+{_MARK}-])|\G)[A-Za-z0-9._%+{_MARK}-]++@[A-Za-z0-9-]++{_MARK}[A-Za-z0-9{_MARK}-]++"),
    "ip": (r"[0-9]\.[0-9]", None, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][ -]?[0-9]", r"(?<=[0-9])[ -](?=[0-9])", rf"(?<![0-9{_MARK}])[0-9](?:{_MARK}?[0-9]){{11,18}}(?![0-9{_MARK}])"),
    "phone": (r"\+[0-9]", None, r"\+[0-9][ ().0-9-]+[0-9]"),
}

#: What may be an identifier of a kind although no base pattern takes it: masked, unprefixed or of another make.
_MAYBE = {
    "email": (r"@", r"(?<!\S)[^\s@]++@[^\s@]++(?!\S)"),
    "ip": (r":[0-9A-Fa-f]*:", r"(?<!\S)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?!\S)"),
    "card": (r"[0-9Xx*]{4}", r"(?<!\S)[0-9Xx*]{4}(?:[ -]?[0-9Xx*]{4}){2,3}(?!\S)"),
    "phone": (r"[0-9][-./ )]", r"(?<!\S)\(?[0-9]{2,5}\)?(?:[-./ ][0-9]{2,5}){1,4}(?!\S)"),
}

_SPANS = "array<struct<start:long,stop:long,txt:string>>"


def _spans(text: Column, pattern: str) -> Column:
    """All matches with their places: each starts after the gaps and matches before it.

    Places are first summed within runs of RUN matches, then each run moves behind the runs before it, so that a text of
    very many matches doesn't copy all earlier ones for each.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def add(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        stop = start + F.length(m["txt"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), m["txt"].alias("txt")))).alias("out"))

    def behind(acc: Column, run: Column) -> Column:
        moved = F.transform(run["out"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), (m["stop"] + acc["at"]).alias("stop"), m["txt"].alias("txt")))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    steps = F.zip_with(found, F.transform(F.slice(gaps, 1, F.size(found)), lambda g: F.length(g).cast("long")), lambda t, g: F.struct(t.alias("txt"), g.alias("gap")))
    none = F.lit(0).cast("long").alias("at")
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / RUN).cast("int")), lambda i: F.aggregate(F.slice(steps, i * RUN + 1, F.lit(RUN)), F.struct(none, F.array().cast(_SPANS).alias("out")), add))
    return F.aggregate(runs, F.struct(none, F.array().cast(f"array<{_SPANS}>").alias("out")), behind, lambda acc: F.flatten(acc["out"]))


def _digits(txt: Column) -> Column:
    return F.regexp_replace(txt, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether every second digit from the right, doubled and its own digits summed, makes a sum divisible by ten with the rest."""

    def value(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def _holds(kind: str, txt: Column) -> Column:
    if kind == "ip":
        return txt.rlike(r"^0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]|(?=\.))(?:\.0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]|(?=\.|$))){3}$")
    if kind == "card":
        return _luhn(_digits(txt))
    if kind == "phone":
        return F.length(_digits(txt)).between(9, 15)
    return F.lit(True)


def _base(text: Column, kind: str) -> Column:
    needed, rewritten, pattern = _BASE[kind]
    seen = text if rewritten is None else F.regexp_replace(F.translate(text, _MARK, _SPARE), rewritten, _MARK)
    return F.when(text.rlike(needed), F.filter(_spans(seen, pattern), lambda s: _holds(kind, s["txt"]))).otherwise(F.array().cast(_SPANS))


def _contexts(text: Column, start: Column, stop: Column) -> Column:
    """What a span stands in, within its line, lower-cased, digits as 0: the two words before it, the two behind it, and the one on
    either side. The first character tells which; those without all of their words are left out."""
    left = F.substring(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS)))
    right = F.substring(text, stop + 1, F.lit(CONTEXT_CHARS))
    before, behind = F.regexp_extract(left, r"(?:^|\s)(\S+[^\S\n]+\S+)[^\S\n]+$", 1), F.regexp_extract(right, r"^[^\S\n]+(\S+[^\S\n]+\S+)(?:\s|$)", 1)
    last, first = F.regexp_extract(left, r"(?:^|\s)(\S+)[^\S\n]+$", 1), F.regexp_extract(right, r"^[^\S\n]+(\S+)(?:\s|$)", 1)
    both = F.when((last != "") & (first != ""), F.concat(F.lit("="), last, F.lit(" "), first))
    every = F.array(F.when(before != "", F.concat(F.lit("<"), before)), F.when(behind != "", F.concat(F.lit(">"), behind)), both)
    return F.transform(F.array_compact(every), lambda c: F.regexp_replace(F.lower(c), "[0-9]+|\\s+", "0"))


def _listed(text: Column, spans: Column, rank: int, seed: bool) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lower(s["txt"]).alias("txt"), _contexts(text, s["start"].cast("int"), s["stop"].cast("int")).alias("contexts"), F.lit(seed).alias("seed")))


def scored_contexts(mentions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(rank, context, trust, seeds) from the graph of contexts and instances: mentions (rank, context, txt, seed).

    A context's trust is the mean score of the different instances in it; a seed's score is 1, another instance's is
    one less the product of its contexts' distrust. Scores pass to and fro for a number of rounds.
    """
    edges = saved(mentions.filter("context IS NOT NULL").groupBy("rank", "context", "txt").agg(F.max("seed").alias("seed")))
    scores = edges.groupBy("rank", "txt").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for i in range(rounds):
        trust = edges.join(scores, ["rank", "txt"]).groupBy("rank", "context").agg(F.avg("score").alias("trust"), F.count_if("seed").alias("seeds"))
        if i + 1 < rounds:
            known = F.col("trust") * F.col("seeds") / (F.col("seeds") + 1)
            distrust = F.sum(F.log(1 - F.least(known, F.lit(0.999))))
            scores = saved(edges.join(trust, ["rank", "context"]).groupBy("rank", "txt").agg(F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(distrust)).alias("score")))
    return trust


def _apart(mentions: DataFrame) -> DataFrame:
    """The mentions without those that overlap a seed in their row: one that starts no later and ends behind their start, or
    starts no earlier and before their end."""
    ahead = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("row").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = mentions.withColumn("_until", F.max(F.when(F.col("seed"), F.col("stop"))).over(ahead)).withColumn("_from", F.min(F.when(F.col("seed"), F.col("start"))).over(back))
    free = (F.coalesce("_until", F.lit(0)) <= F.col("start")) & (F.coalesce("_from", F.col("stop")) >= F.col("stop"))
    return rows.filter(F.col("seed") | free).drop("_until", "_from")


def personal_data(docs: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, seeds: int = SEEDS) -> DataFrame:
    """One row per document: counts of base spans by kind, base_sha256, spans (all, as kind:start:end), n_added.

    Base patterns find the seeds. Their contexts (words before, behind and around them, in the line) are scored against
    all instances that stand in them, over the whole table; in a context of high trust with enough different seeds,
    strings that may be of its kind become spans too, unless they overlap a base span of any kind. A null text is empty: no spans. Repeated
    rows are handled each; rows without an id keep theirs null; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id"), text.alias("text"), *[_base(text, k).alias(f"base_{k}") for k in KINDS])
    every = F.flatten(F.array(*[_listed(F.col("text"), F.col(f"base_{k}"), i, True) for i, k in enumerate(KINDS)]))
    maybe = F.flatten(F.array(*[F.when(F.col("text").rlike(need), _listed(F.col("text"), _spans(F.col("text"), pattern), i, False)).otherwise(F.slice(F.col("known"), 1, 0)) for i, (need, pattern) in enumerate(_MAYBE.values())]))
    rows = base.withColumn("known", every).withColumn("maybe", maybe)
    rows = saved(rows.select("doc_id", F.array_sort("known").alias("known"), "maybe").withColumn("row", F.monotonically_increasing_id()))

    mentions = rows.filter("size(known) + size(maybe) > 0").select("row", F.explode(F.concat("known", "maybe")).alias("m")).select("row", "m.*")
    mentions = _apart(mentions).select("row", "rank", "start", "stop", "txt", "seed", F.explode("contexts").alias("context"))
    good = scored_contexts(mentions, rounds).filter((F.col("trust") >= trust) & (F.col("seeds") >= seeds)).select("rank", "context")
    added = mentions.filter("NOT seed").join(small(saved(good)), ["rank", "context"])
    added = small(saved(added.groupBy("row").agg(F.collect_set(F.struct("start", "rank", "stop")).alias("added"))))
    name = F.array(*map(F.lit, KINDS))

    def text_of(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(name, s["rank"] + 1), s["start"], s["stop"])), ",")

    plain = F.transform("known", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop")))
    extra = F.coalesce("added", F.slice(plain, 1, 0))
    ranks = F.transform("known", lambda s: s["rank"])
    counts = [(F.size(ranks) - F.size(F.array_remove(ranks, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.join(added, "row", "left").select("doc_id", *counts, F.sha2(text_of(plain), 256).alias("base_sha256"), text_of(F.concat(plain, extra)).alias("spans"), F.size(extra).cast("long").alias("n_added"))
