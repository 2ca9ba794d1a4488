"""Personal data: patterns, and terms that give a protected entity away by co-occurrence.

DataFrame expressions only. Places come from splitting a text at its matches: the lengths of the
pieces and of the matches add up to every start.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tollgate.llm.registry import query, table
from tollgate.session import checkpointed

#: Kinds in the order in which spans of one start are listed. The patterns match what plain ones
#: match; possessive parts and look-behind keep a failing match from being tried at every place.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "term": r"\p{L}{4,}",
}
BASE = ("email", "ip", "card", "phone")
#: A term discloses a target, an entity or a class of entities, if so large a share of the documents
#: with the term hold the target, if the two share so many bits, and if the different texts that hold
#: both save more bits than it takes to name one of all pairs that stand together.
GENERALISE = 0.5
REMOVE = 0.9
BITS = 3.0


def _matches(kind: str, text: Column, may: Column) -> Column:
    """Array of (kind, i, gap, match) of all matches; ``may``: a match is possible."""
    pattern = F.lit(KINDS[kind])
    pieces = F.split(text, KINDS[kind], -1)
    found = F.transform(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.length(F.get(pieces, i)).alias("gap"),
            x.alias("match"),
        ),
    )
    kind_of = "array<struct<kind:string,i:int,gap:int,match:string>>"
    return F.when(may, found.cast(kind_of)).otherwise(F.array().cast(kind_of))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled, less 9 if that has two digits."""

    def value(j: Column) -> Column:
        d = F.substring(digits, F.length(digits) - j + 1, F.lit(1)).cast("int")
        return F.when(j % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, j: acc + value(j)) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    part = F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    card = F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", part).when(kind == "card", card).otherwise(F.length(digits).between(10, 15))


def _terms(text: Column) -> Column:
    """The distinct terms of a text outside its entities; of these only e-mail addresses hold letters."""
    outside = F.when(text.contains("@"), F.regexp_replace(text, KINDS["email"], " ")).otherwise(text)
    return F.array_distinct(F.transform(F.regexp_extract_all(outside, F.lit(KINDS["term"]), F.lit(0)), F.lower))


def _targets(kind: Column, match: Column) -> Column:
    """What a term can disclose of an entity: its value, what it shares with others (domain, network,
    issuer, leading digits) and its kind."""
    plain = F.when(kind == "email", F.lower(match)).otherwise(F.regexp_replace(match, "[^0-9.]", ""))
    parts = F.split(plain, r"\.")
    shared = F.when(kind == "email", F.substring_index(plain, "@", -1)).when(kind == "ip", F.concat_ws(".", F.slice(parts, 1, 2)))
    shared = shared.when(kind == "card", F.left(plain, F.lit(6))).otherwise(F.left(_digits(match), F.lit(4)))
    return F.array(F.concat_ws(":", kind, plain), F.concat_ws(":", F.lit("class"), kind, shared), F.concat_ws(":", F.lit("kind"), kind))


def disclosing(rows: DataFrame, holders: DataFrame, targets: DataFrame) -> DataFrame:
    """(row, term, action) of the terms of a document that disclose a target of the same document.

    ``rows``, ``holders``: (row, text) of all and of those with entities; ``targets``: distinct
    (row, target). Terms count wherever they stand in a document. Documents are counted by row;
    as evidence copies of a text count once.
    """
    n = max(rows.count(), 1)
    sizes = targets.groupBy("row").agg(F.count("*").alias("n_targets"))
    held = checkpointed(holders.join(sizes, "row").select("row", F.xxhash64("text").alias("mixed"), "n_targets", _terms(F.col("text")).alias("terms")))
    tested = held.agg(F.sum(F.col("n_targets") * F.size("terms"))).first()[0] or 0
    name_bits = math.log2(max(tested, 1))
    words = rows.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("term_docs"))
    # no pair is lost: a term stands with a target in no more documents than hold any, and a text saves log2(n) bits at most
    within = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("held_docs")).where(F.col("held_docs") * math.log2(n) >= name_bits)
    likely = within.join(words, "term").where(F.col("held_docs") >= GENERALISE * F.col("term_docs"))
    stands = held.select("row", "mixed", F.explode("terms").alias("term")).join(likely.select("term", "term_docs"), "term")
    seen = checkpointed(stands).join(targets, "row")
    pairs = seen.groupBy("target", "term", "mixed").agg(F.count("*").alias("copies"), F.max("term_docs").alias("term_docs"))
    pairs = pairs.groupBy("target", "term").agg(F.sum("copies").alias("together"), F.count("*").alias("texts"), F.max("term_docs").alias("term_docs"))
    counts = targets.groupBy("target").agg(F.count("*").alias("target_docs"))
    share, base = F.col("together") / F.col("term_docs"), F.col("target_docs") / F.lit(float(n))
    apart = F.col("term_docs") - F.col("together")
    saved = F.col("texts") * F.log2(share / base) + F.when(apart > 0, apart * F.log2((1 - share) / (1 - base))).otherwise(0.0)
    # the four kinds meet nearly all terms: their counts go to the pairs, those of the others are joined
    kind = F.col("target").startswith("kind:")
    told = pairs.where(kind).join(F.broadcast(counts.where(kind)), "target").unionByName(pairs.where(~kind).join(counts.where(~kind), "target"))
    told = told.where((share >= GENERALISE) & (F.log2(share / base) >= BITS) & (saved >= name_bits))
    told = checkpointed(told.select("target", "term", (share >= REMOVE).alias("whole")))
    found = seen.join(told, ["target", "term"]).groupBy("row", "term").agg(F.max("whole").alias("whole"))
    return found.select("row", "term", F.when(F.col("whole"), "remove").otherwise("generalise").alias("action"))


def _places(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(row, start, rank, end, kind, action) of every place of the terms ``found`` in their rows."""
    told = found.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("told"))
    words = rows.join(told, "row").select("row", "told", F.regexp_extract_all("text", F.lit(KINDS["term"]), F.lit(0)).alias("word"), F.split("text", KINDS["term"], -1).alias("gap"))
    words = words.select("row", "told", F.posexplode(F.arrays_zip("word", "gap")).alias("i", "at"))
    words = words.select("row", "i", F.col("at.gap").alias("gap"), F.col("at.word").alias("word"), F.try_element_at("told", F.lower("at.word")).alias("action"))
    before = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("gap") + F.length("word")).over(before)
    words = words.where("word is not null").withColumn("end", end).where("action is not null")
    return words.select("row", (F.col("end") - F.length("word")).alias("start"), F.lit(4).alias("rank"), "end", F.lit("term").alias("kind"), "action")


def private_spans(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per row of (row, text, ...): the columns ``keep`` and row, base and terms, both arrays of
    (start, rank, end, kind), in order; ``action`` of a term is remove or generalise.

    ``row`` tells rows apart. Null texts count as empty ones and hold no spans.
    """
    text = F.coalesce("text", F.lit(""))
    digit = text.rlike("[0-9]")
    may = {"email": text.contains("@"), "ip": digit, "card": digit, "phone": text.contains("+")}
    found = rows.select("row", *keep, "text", F.concat(*[_matches(k, text, may[k]) for k in BASE]).alias("m"))
    # only texts with an entity go on: they alone are shuffled later
    holds = F.exists("m", lambda x: F.coalesce(_valid(x["kind"], x["match"]), F.lit(False)))
    found = checkpointed(found.select("row", *keep, F.when(holds, F.col("text")).alias("text"), "m"))
    heads, holders = found.select("row", *keep), found.where("text is not null").select("row", "text")
    places = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("match")).over(places)
    spans = found.select("row", F.explode("m").alias("m")).select("row", "m.*").withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    spans = checkpointed(spans.where(_valid(F.col("kind"), F.col("match"))))

    targets = checkpointed(spans.select("row", F.explode(_targets(F.col("kind"), F.col("match"))).alias("target")).distinct())
    terms = _places(holders, disclosing(rows, holders, targets))

    rank = F.array_position(F.array(*[F.lit(k) for k in BASE]), F.col("kind")).cast("int") - 1
    base = spans.select("row", "start", rank.alias("rank"), "end", "kind", F.lit("remove").alias("action"))
    every = base.union(terms).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "action"))).alias("all"))
    out = heads.join(every, "row", "left")
    base = F.coalesce(F.filter("all", lambda s: s["kind"] != "term"), F.array())
    clear = F.filter("all", lambda t: (t["kind"] == "term") & ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    kind = "array<struct<start:bigint,rank:int,end:bigint,kind:string,action:string>>"
    return out.select("row", *keep, base.cast(kind).alias("base"), F.coalesce(clear, F.array()).cast(kind).alias("terms"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with entities and disclosing terms in its texts replaced: entities by their kind in
    brackets, terms by ``[term]`` (generalised) or nothing (removed); of overlapping spans the
    first counts. Null texts stay null, repeated rows and extra columns stay."""
    names = docs.columns
    rows = checkpointed(docs.select(F.monotonically_increasing_id().alias("row"), "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")))
    spans = private_spans(rows).select(F.col("row").alias("row2"), F.array_sort(F.concat("base", "terms")).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,put:string>>")

    def put(s: Column) -> Column:
        return F.when((s["kind"] == "term") & (s["action"] == "remove"), "").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))

    single = F.aggregate(
        "spans",
        empty,
        lambda acc, s: F.when(s["start"] >= F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)), F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), put(s).alias("put"))))).otherwise(acc),
    )
    text = F.col("text")
    joined = rows.join(spans, F.col("row") == F.col("row2")).withColumn("single", single)
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("single"), i - 1)["end"])
    parts = F.transform("single", lambda s, i: F.concat(F.substring(text, (before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int")), s["put"]))
    last = F.coalesce(F.get(F.col("single"), F.size("single") - 1)["end"], F.lit(0))
    whole = F.concat(F.array_join(parts, ""), F.substring(text, (last + 1).cast("int"), F.length(text)))
    return joined.select(*[whole.alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in names])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op5_information_sanitiser")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    out = private_spans(docs, "doc_id")
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "terms"))).alias("spans"))
