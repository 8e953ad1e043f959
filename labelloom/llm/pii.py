"""Personal data: fixed patterns, and contextual patterns bootstrapped from what they find.

What the fixed patterns find are the seeds. The words around a seed are a lexical pattern; tokens that look like
identifiers (with a digit or @) and the patterns they occur in form a graph. A pattern is trusted by its distinct tokens that
are seeds or already trusted, weighed against those known to be something else, and a token by the patterns that it
occurs in; a few rounds spread the trust. Where a trusted pattern stands before or around a token that no fixed pattern covers, that is a find.

Everything is DataFrame functions. Positions count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.llm.common import packed, unpacked
from labelloom.staging import stage

#: The fixed patterns, with starts and quantifiers such that a failed attempt is never repeated inside
#: a run of characters; they match what the plain forms match. The card pattern skips runs of under 16 digits, which would be dropped.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15}(?:[ -]?[0-9])*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: The words next to a match mostly lie within so many code points; where they do not, the whole text up to the next match is looked at.
NEAR = 48
#: Matches of a text whose places are summed together.
BLOCK = 64
ROUNDS, SUPPORT, TRUST = 3, 4, 0.8
#: Weight of a token of which nothing is known, and the share of trusted tokens under which a pattern tells against its others.
UNSEEN, DOUBT = 0.1, 0.1

TWO_BEFORE, TWO_WHOLE = r"(?:^\s++|(?<!\S)\S++\s++\S++\s*+|(?<!\S)\S++\s*+)$", r"\s\S++\s++\S++\s*+$"
ONE_AFTER, ONE_WHOLE = r"^\s*+(\S++)", r"^\s*+\S++\s"

SPAN = "array<struct<kind:int,start:int,stop:int>>"
BASE = "array<struct<kind:int,start:int,stop:int,value:string,after:string>>"
FOUND = "array<struct<start:int,stop:int,value:string,before:string,after:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def two_before(gap: Column) -> Column:
    """The last two words of a text, or the only one, and the blanks after them."""
    near = F.right(gap, F.lit(NEAR))
    return F.regexp_extract(F.when(near.rlike(TWO_WHOLE), near).otherwise(gap), TWO_BEFORE, 0)


def one_after(gap: Column) -> Column:
    """The first word of a text."""
    near = F.left(gap, F.lit(NEAR))
    return F.regexp_extract(F.when(near.rlike(ONE_WHOLE), near).otherwise(gap), ONE_AFTER, 1)


def located(text: Column, pattern: str) -> Column:
    """Matches with their places and whole words on either side: ``start, stop, value, before, after``.

    ``before`` are the last two words since the previous match, ``after`` is the first one up to the next match.

    Places are running sums. They are taken in blocks of ``BLOCK`` matches, and then over the blocks, as a fold that appends to an
    array copies it each time; so a text with many matches takes hardly more than one pass.
    """

    def matches(found: Column) -> Column:
        n = F.size(found["hits"])
        left = F.zip_with(
            F.slice(found["gaps"], F.lit(1), n),
            found["hits"],
            lambda g, h: F.struct(F.char_length(g).alias("gap"), F.char_length(h).alias("size"), h.alias("value"), two_before(g).alias("before")),
        )
        return F.zip_with(left, F.slice(found["gaps"], F.lit(2), n), lambda m, g: m.withField("after", one_after(g)))

    def step(acc: Column, m: Column) -> Column:
        begin, stop = acc["at"] + m["gap"], acc["at"] + m["gap"] + m["size"]
        span = F.struct(begin.alias("start"), stop.alias("stop"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after"))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(span)).cast(FOUND).alias("spans"))

    def in_blocks(all_matches: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("spans"))
        begins = F.sequence(F.lit(1), F.size(all_matches), F.lit(BLOCK))
        blocks = F.transform(begins, lambda i: F.aggregate(F.slice(all_matches, i, F.lit(BLOCK)), none, step))
        return F.when(F.size(all_matches) > 0, let(blocks, joined)).otherwise(F.array().cast(FOUND))

    def joined(blocks: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))
        begins = F.aggregate(
            blocks, none, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["begins"], F.array(acc["at"])).alias("begins")), lambda acc: acc["begins"]
        )

        def moved(block: Column, at: Column) -> Column:
            return F.transform(block["spans"], lambda s: s.withField("start", s["start"] + at).withField("stop", s["stop"] + at))

        return F.flatten(F.zip_with(blocks, begins, moved)).cast(FOUND)

    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return let(let(found, matches), in_blocks)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    backwards = F.split(F.reverse(number), "")

    def add(total: Column, place: Column) -> Column:
        d = F.element_at(backwards, place).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(place % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.char_length(digits(value)).between(16, 19) & luhn(digits(value))
    if kind == "phone":
        return F.char_length(digits(value)).between(8, 15)
    return F.lit(True)


def base_found(text: Column) -> Column:
    """Valid matches of the fixed patterns, by kind and start, with their value and the word after."""
    parts = []
    for number, kind in enumerate(KINDS):
        needed = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike("[0-9](?:[ -]?[0-9]){15}")
        parts.append(F.when(needed, F.transform(_valid_only(kind, text), _as_base(number))).otherwise(F.array().cast(BASE)))
    return F.concat(*parts)


def base_spans(text: Column) -> Column:
    """Valid matches of the fixed patterns, by kind and start."""
    return places(base_found(text))


def places(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))


def _valid_only(kind: str, text: Column) -> Column:
    return F.filter(located(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))


def _as_base(number: int):
    return lambda s: F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value"), s["after"].alias("after"))


def labelled(tokens: Column, base: Column, length: Column) -> Column:
    """The tokens that are seeds or that no fixed match touches.

    The text is cut into about as many ranges as the root of the number of matches, each with the matches in it, and a token is compared with
    those of its own ranges only.
    """
    width = F.ceil(F.greatest(length, F.lit(1)) / F.ceil(F.sqrt(F.size(base) + 1))).cast("int")

    def in_ranges(w: Column) -> Column:
        begins = F.sequence(F.lit(0), F.greatest(length, F.lit(1)) - 1, w)
        return F.struct(w.alias("width"), F.transform(begins, lambda at: F.filter(base, lambda s: (s["start"] < at + w) & (s["stop"] > at))).alias("matches"))

    def label(t: Column, ranges: Column) -> Column:
        first, last = F.floor(t["start"] / ranges["width"]).cast("int"), F.floor((t["stop"] - 1) / ranges["width"]).cast("int")
        around = F.flatten(F.slice(ranges["matches"], first + 1, last - first + 1))
        return let(F.filter(around, lambda s: (s["start"] < t["stop"]) & (s["stop"] > t["start"])), lambda touching: told(t, touching))

    def told(t: Column, touching: Column) -> Column:
        seed = F.array_min(F.filter(touching, lambda s: s["start"] >= t["start"]))
        return F.struct(
            t["start"].alias("start"),
            t["stop"].alias("stop"),
            F.coalesce(seed["value"], t["value"]).alias("value"),
            t["before"].alias("before"),
            F.coalesce(seed["after"], t["after"]).alias("after"),
            seed["kind"].alias("kind"),
            (F.size(touching) > 0).alias("touched"),
        )

    every = let(let(width, in_ranges), lambda ranges: F.transform(tokens, lambda t: label(t, ranges)))
    return F.filter(every, lambda t: t["kind"].isNotNull() | ~t["touched"])


def marked(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, base, tokens`` for every row, written once; tokens have ``kind`` (null: not a seed).

    A token that a fixed match starts in is a seed of its kind, with the whole match as its value and what follows the
    match as its context; a token that a match only reaches into is left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = F.when(text.rlike("[0-9@]"), located(text, TOKEN)).otherwise(F.array().cast(FOUND))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.char_length(text).alias("length"), base_found(text).alias("found"), tokens.alias("tokens"))
    told = labelled(F.col("tokens"), F.col("found"), F.col("length"))
    return stage(rows.select("doc_id", "text_hash", places(F.col("found")).alias("base"), told.alias("tokens")), "marked")


def occurrences(marks: DataFrame) -> DataFrame:
    """A row for each token and pattern it stands in: ``doc_id, text_hash, start, stop, kind, instance, pattern``.

    Patterns are the two words before, and the word before with the word after, in lower case.
    """
    t = marks.select("doc_id", "text_hash", F.explode("tokens").alias("t")).select("doc_id", "text_hash", "t.*")
    lead, trail = F.regexp_extract("value", r"^[^\p{L}\p{N}+@]*", 0), F.regexp_extract("value", r"[^\p{L}\p{N}]*$", 0)
    t = t.withColumn("start", F.col("start") + F.char_length(lead)).withColumn("stop", F.col("stop") - F.char_length(trail)).where("start < stop")
    t = t.withColumn("instance", F.lower(F.regexp_replace("value", r"^[^\p{L}\p{N}+@]*|[^\p{L}\p{N}]*$", "")))
    before, after = F.filter(F.split(F.lower("before"), r"\s+"), lambda w: w != ""), F.lower("after")
    two, one = F.array_join(before, " "), F.try_element_at(before, F.lit(-1))
    patterns = F.array(F.when(F.size(before) == 2, F.concat(two, F.lit(" _"))), F.when(one.isNotNull() & (after != ""), F.concat(one, F.lit(" _ "), after)))
    return t.withColumn("pattern", F.explode(F.filter(patterns, lambda p: p.isNotNull()))).drop("value", "before", "after", "touched")


def trusted_patterns(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, trust: float = TRUST) -> tuple[DataFrame, DataFrame]:
    """``pattern, kind, trust``: patterns with at least ``support`` distinct trusted tokens of one kind that are the share
    ``trust`` of what tells for or against it; and ``instance``: the tokens that tell against.

    Against a pattern are tokens trusted as another kind, and those that stand mostly in distrusted patterns: patterns with at
    least ``support`` distinct tokens of which hardly any is trusted. Any other token is what a pattern is there to
    discover; it weighs ``UNSEEN``, so that a handful of seeds cannot carry an open context. One more counts against. Distinct
    tokens are counted, so a passage that many documents share counts once.
    """
    edges = stage(found.groupBy("pattern", "instance").agg(F.max("kind").alias("seed")), "edges")
    seeds = edges.where("seed IS NOT NULL").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    known, good, against, before = seeds, None, None, -1
    for _ in range(rounds):
        scored = edges.join(known, "instance", "left")
        per_kind = scored.groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.count("score").alias("n"), F.count(F.lit(1)).alias("all"))
        best = per_kind.groupBy("pattern").agg(
            F.max(F.struct(F.coalesce("score", F.lit(0.0)).alias("score"), "n", "kind")).alias("b"), F.sum("n").alias("known"), F.sum("all").alias("all")
        )
        best = stage(best, "scored_patterns")
        doubtful = best.where((F.col("all") >= support) & (F.col("known") < DOUBT * F.col("all"))).select("pattern", F.lit(1).alias("doubt"))
        places = edges.where("seed IS NULL").join(doubtful, "pattern", "left").groupBy("instance").agg(F.count("doubt").alias("n"), F.count(F.lit(1)).alias("all"))
        against = stage(places.where("n * 2 > all").select("instance").join(known.select("instance"), "instance", "left_anti"), "against")
        likely = best.where(F.col("b.n") >= support)
        contrary = edges.join(likely.select("pattern"), "pattern", "left_semi").join(against, "instance").groupBy("pattern").agg(F.count(F.lit(1)).alias("contrary"))
        likely = likely.join(contrary, "pattern", "left").withColumn("told", F.col("known") + F.coalesce("contrary", F.lit(0)))
        share = F.col("b.score") / (F.col("told") + UNSEEN * (F.col("all") - F.col("told")) + 1)
        good = stage(likely.where(share >= trust).select("pattern", F.col("b.kind").alias("kind"), share.alias("trust")), "patterns")
        size = good.count()
        if size == before:
            break
        before = size
        drawn = edges.where("seed IS NULL").join(good, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score"))
        one = drawn.groupBy("instance").agg(F.max(F.struct("score", "kind")).alias("b")).select("instance", "b.kind", "b.score")
        known = seeds.unionByName(one.where(F.col("score") >= trust).join(against, "instance", "left_anti"))
    return good, against


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, base, spans`` for every row: fixed matches, and these with the finds, by kind and start.

    A null text is empty. Repeated rows come out as often. Finds carry the kind of their pattern's seeds and never
    touch a fixed match; tokens that stand mostly in distrusted patterns are none. Other columns are not read.
    """
    marks = marked(docs)
    found = occurrences(marks)
    good, against = trusted_patterns(found)
    more = (
        found.where("kind IS NULL")
        .drop("kind")
        .join(good, "pattern")
        .join(against, "instance", "left_anti")
        .groupBy("doc_id", "text_hash", "start", "stop")
        .agg(F.max(F.struct("trust", F.col("kind").alias("k")))["k"].alias("kind"))
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        .agg(F.collect_list(F.struct("kind", "start", "stop")).cast(SPAN).alias("more"))
    )
    return marks.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select(
        "doc_id", "text_hash", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))).alias("spans")
    )


def count_of(kind: int, spans: str = "base") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"], s["stop"])), ",")


def _run(spans: Column, ends: Column) -> Column:
    return F.struct(spans.alias("spans"), ends["at"].alias("at"), ends["end"].alias("end"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; spans that overlap become one mark."""
    found = find(docs).select("doc_id", "text_hash", "spans").where(F.size("spans") > 0)
    found = found.dropDuplicates(["doc_id", "text_hash"]).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    text = F.col("text")
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    kind = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(chunk: Column, begin: Column):
        def one(acc: Column, s: Column) -> Column:
            out = F.concat(acc["out"], F.substring(chunk, acc["at"] - begin + 1, s["start"] - acc["at"]), F.element_at(kind, s["kind"] + 1))
            return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(s["start"] >= acc["at"], out).otherwise(acc["out"]).alias("out"))

        return one

    def run_out(run: Column) -> Column:
        """The text from where the runs before ended to where this one ends, with its marks."""
        chunk = F.substring(text, run["at"] + 1, run["end"] - run["at"])
        none = F.struct(run["at"].alias("at"), F.lit("").alias("out"))
        return let(chunk, lambda c: F.aggregate(run["spans"], none, step(c, run["at"]), lambda acc: acc["out"]))

    def in_runs(spans: Column) -> Column:
        """Spans in runs of the root of their number, each with the end of all before (``at``) and with it (``end``)."""
        size = F.ceil(F.sqrt(F.size(spans))).cast("int")
        runs = F.transform(F.sequence(F.lit(1), F.size(spans), size), lambda i: F.slice(spans, i, size))
        ends = F.aggregate(
            F.transform(runs, lambda r: F.array_max(F.transform(r, lambda s: s["stop"]))),
            F.array(F.lit(0)),
            lambda acc, top: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), top))),
        )
        return let(ends, lambda e: F.zip_with(runs, F.arrays_zip(F.slice(e, F.lit(1), F.size(e) - 1).alias("at"), F.slice(e, F.lit(2), F.size(e)).alias("end")), _run))

    def put_together(runs: Column) -> Column:
        rest = F.substring(text, F.element_at(runs, -1)["end"] + 1, F.char_length(text))
        return F.concat(F.array_join(F.transform(runs, run_out), ""), rest)

    clean = let(let(by_start, in_runs), put_together)
    rows = packed(docs, "doc_id", "text")
    joined = rows.join(found, rows["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_hash")), "left")
    return unpacked(joined.withColumn("text", F.when(F.col("spans").isNull(), text).otherwise(clean)), docs.columns, "doc_id", "text")
