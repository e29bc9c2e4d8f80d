"""Mixing sources to target weights, with DataFrame functions only.

Temperature mixing: the weight of a source is its token share to the power of an
exponent. The exponent is bisected to meet a target entropy of the weights or a limit on how
often a source may be repeated. The weights are realised by budgeted block permutations: a source is
dealt into blocks; it gives as many whole passes as its budget holds, and then blocks in
permuted order, the last one only in part, until the budget is spent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_of

#: More sources than this are an error, so their table may be broadcast.
MAX_SOURCES = 100_000
BLOCK_ROWS = 256
MAX_BLOCKS = 65_536
STEPS = 40
#: Largest exponent tried for a target entropy.
STEEPEST = 64.0
SEED = "weft"


def _hash(*parts: Column) -> Column:
    """60 bits of an md5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *parts)), 1, 15), 16, 10).cast("long")


def _key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))


def _row_hash(id_col: str) -> Column:
    return _hash(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def _exponent(table: DataFrame, target_entropy: float | None, max_repetition: float) -> DataFrame:
    """One row (alpha, top, met) from the source table: the smallest exponent in 0 to 1 that keeps the limit.

    With ``target_entropy`` (natural units) it is the exponent from 0 to ``STEEPEST`` that meets it: above 1 for less
    entropy than the sources have. 0 if even weights have no more; ``met`` is false if no exponent has so little.
    """
    packed = table.filter("tokens > 0").agg(F.sort_array(F.collect_list(F.col("tokens").cast("double"))).alias("t"))

    def holds(alpha: Column) -> Column:
        if target_entropy is None:
            most = F.pow(F.element_at("t", -1) / F.element_at("t", 1), 1 - alpha)
            return most <= F.lit(float(max_repetition))
        powers = F.transform("t", lambda x: F.pow(x / F.element_at("t", -1), alpha))
        total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
        entropy = F.aggregate(powers, F.lit(0.0), lambda a, x: a - x / total * F.log(x / total))
        return entropy <= F.lit(float(target_entropy))

    most = 1.0 if target_entropy is None else STEEPEST
    ends = F.struct(F.lit(0.0).alias("low"), F.lit(most).alias("high"))

    def step(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        ok = holds(middle)
        return F.struct(F.when(ok, acc["low"]).otherwise(middle).alias("low"), F.when(ok, middle).otherwise(acc["high"]).alias("high"))

    bisected = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), ends, step)
    alpha = F.when(holds(F.lit(0.0)), F.lit(0.0)).otherwise(F.round(bisected["high"], 9))
    return packed.filter(F.size("t") > 0).select(alpha.alias("alpha"), F.element_at("t", -1).alias("top"), holds(F.lit(most)).alias("met"))


def weigh(rows: DataFrame, target_entropy: float | None = None, max_repetition: float = 2.0, budget: int | None = None) -> DataFrame:
    """Sources of ``rows`` (source_key, n_tokens) with tokens, n_rows, weight, full, rest.

    ``budget`` is the total of tokens to realise; without one it is the least that gives every row once. A source of no
    tokens has weight 0 and is given once. A target entropy that no exponent meets (there are as large sources) is an error.
    """
    table = materialise(rows.groupBy("source_key").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows")), "sources")
    if (n := table.count()) > MAX_SOURCES:
        raise ValueError(f"{n} sources; at most {MAX_SOURCES} are mixed")
    one = materialise(_exponent(table, target_entropy, max_repetition), "exponent").first()
    alpha, top = (one.alpha, one.top) if one else (1.0, 1.0)
    if one and not one.met:
        raise ValueError(f"no weights of these sources have an entropy of {target_entropy}")
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(one.top if one else 1.0), F.lit(alpha))).otherwise(0.0)
    total = table.agg(F.sum(power)).first()[0] or 1.0
    weight = power / F.lit(total)
    # without a budget the source with most tokens for its weight is given exactly once: the largest, unless the exponent exceeds 1
    if alpha > 1:
        top = table.filter("tokens > 0").agg(F.max(F.col("tokens") / power)).first()[0]
    goal = F.lit(top) * power if budget is None else F.lit(float(budget)) * weight
    goal = F.round(goal).cast("long")
    some = F.col("tokens") > 0
    return table.select(
        "source_key",
        "tokens",
        "n_rows",
        F.round(weight, 9).alias("weight"),
        F.when(some, F.floor(goal / F.col("tokens"))).otherwise(1).cast("int").alias("full"),
        F.when(some, goal % F.col("tokens")).otherwise(0).cast("long").alias("rest"),
        F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("n_rows") / BLOCK_ROWS)).cast("long").alias("n_blocks"),
    )


def _block(n_blocks: str = "n_blocks") -> Column:
    return F.pmod(F.col("__h"), F.col(n_blocks))


def schedule(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``sources`` with the place (block_at, row_at, id_at) up to which the last, partial pass goes.

    ``rows`` has source_key, doc_id, n_tokens, __h. Blocks are summed first; only the one block of each source in
    which the budget ends is looked at row by row.
    """
    some = sources.filter("rest > 0")
    dealt = rows.join(F.broadcast(some), "source_key").withColumn("block", _block())
    order = _hash(F.col("source_key"), F.col("block").cast("string"))
    blocks = dealt.groupBy("source_key", "block").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest")).withColumn("block_h", order)
    by_source = Window.partitionBy("source_key").orderBy("block_h", "block").rowsBetween(Window.unboundedPreceding, 0)
    running = blocks.withColumn("upto", F.sum("n").over(by_source))
    ending = running.filter("upto > rest").groupBy("source_key").agg(F.min(F.struct("block_h", "block", "upto", "n", "rest")).alias("b"))
    ending = materialise(ending.select("source_key", "b.block_h", "b.block", (F.col("b.rest") - F.col("b.upto") + F.col("b.n")).alias("left")), "ending")
    last = dealt.drop("rest").join(F.broadcast(ending), ["source_key", "block"])
    by_row = Window.partitionBy("source_key").orderBy("__h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    taken = last.withColumn("upto", F.sum("n_tokens").over(by_row)).filter("upto <= left")
    at = taken.groupBy("source_key").agg(F.max(F.struct("__h", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("id"))).alias("r"))
    at = at.select("source_key", F.col("r.__h").alias("row_at"), F.col("r.id").alias("id_at"))
    return sources.join(F.broadcast(ending.select("source_key", F.col("block_h").alias("block_at"), F.col("block").alias("block_id"))), "source_key", "left").join(F.broadcast(at), "source_key", "left")


def _passes() -> Column:
    """Passes that give a row of a scheduled source: the whole ones, and the partial one if the row is within it."""
    block_h = _hash(F.col("source_key"), _block().cast("string"))
    before = (block_h < F.col("block_at")) | ((block_h == F.col("block_at")) & (_block() < F.col("block_id")))
    ident = F.coalesce(F.col("doc_id"), F.lit(-(1 << 62)))
    within = (block_h == F.col("block_at")) & (_block() == F.col("block_id")) & ((F.col("__h") < F.col("row_at")) | ((F.col("__h") == F.col("row_at")) & (ident <= F.col("id_at"))))
    extra = (F.col("rest") > 0) & (before | within)
    return F.col("full") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    words = F.regexp_count(text_of(text_col), F.lit(r"\S+")).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(source_col).alias("source_key"), words.alias("n_tokens"), _row_hash(id_col).alias("__h"))


def mix(docs: DataFrame, target_entropy: float | None = None, max_repetition: float = 2.0, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", places: bool = False) -> DataFrame:
    """One row per row of ``docs`` and pass that gives it: doc_id, source, epoch, n_tokens, weight.

    With ``places`` also block_place and row_place: the permutation of a source's pass is by block_place, then row_place.

    Tokens are runs of characters other than white space; null texts have none. Null sources are one
    source. Rows with one id are in one place of the permutation. An empty table gives an empty result.
    """
    rows = materialise(_slim(docs, id_col, text_col, source_col), "rows")
    sources = materialise(schedule(rows, weigh(rows, target_entropy, max_repetition, budget)), "schedule")
    told = rows.join(F.broadcast(sources), "source_key").withColumn("passes", _passes()).filter("passes > 0")
    source = F.when(F.col("source_key") == "n", F.lit(None)).otherwise(F.expr("substring(source_key, 2)"))
    return told.select("doc_id", source.alias("source"), F.explode(F.sequence(F.lit(1), F.col("passes").cast("int"))).alias("epoch"), "n_tokens", "weight", *([_hash(F.col("source_key"), _block().cast("string")).alias("block_place"), F.col("__h").alias("row_place")] if places else []))


def mixed_documents(docs: DataFrame, target_entropy: float | None = None, max_repetition: float = 2.0, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mixture gives it; the columns stay the same and no text is shuffled."""
    rows = materialise(_slim(docs, id_col, text_col, source_col), "rows")
    sources = materialise(schedule(rows, weigh(rows, target_entropy, max_repetition, budget)), "schedule")
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    keyed = docs.select(row, F.col(id_col).cast("long").alias("doc_id"), _key(source_col).alias("source_key"), _row_hash(id_col).alias("__h"))
    told = keyed.join(F.broadcast(sources), "source_key").withColumn("passes", _passes()).filter("passes > 0")
    spread = told.withColumn("__pass", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int"))))
    return spread.select(*[F.col("__row")[c].alias(c) for c in docs.columns])


#: The same mixture in DuckDB's SQL, for documents without nulls in doc_id and source.
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, 's' || source AS k, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]+')) AS n_tokens,
         CAST('0x' || substr(md5('{SEED}|' || doc_id), 1, 15) AS BIGINT) AS h FROM documents
), s AS (SELECT k, sum(n_tokens)::BIGINT AS tokens, count(*) AS n_rows FROM d GROUP BY k),
e AS (SELECT max(tokens)::DOUBLE AS top, min(tokens)::DOUBLE AS least FROM s WHERE tokens > 0),
b(i, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN pow(top / least, 1 - (low + high) / 2) <= 2.0 THEN low ELSE (low + high) / 2 END,
         CASE WHEN pow(top / least, 1 - (low + high) / 2) <= 2.0 THEN (low + high) / 2 ELSE high END
  FROM b, e WHERE i < {STEPS}
), a AS (SELECT CASE WHEN top / least <= 2.0 THEN 0.0 ELSE (SELECT round(high, 9) FROM b WHERE i = {STEPS}) END AS alpha, top FROM e),
p AS (SELECT s.*, CASE WHEN tokens > 0 THEN pow(tokens / top, alpha) ELSE 0 END AS power, top FROM s, a),
w AS (
  SELECT k, tokens, n_rows, round(power / (SELECT sum(power) FROM p), 9) AS weight,
         CASE WHEN tokens > 0 THEN CAST(round(top * power) AS BIGINT) // tokens ELSE 1 END AS full_passes,
         CASE WHEN tokens > 0 THEN CAST(round(top * power) AS BIGINT) % tokens ELSE 0 END AS rest,
         least({MAX_BLOCKS}, CAST(ceil(n_rows / {BLOCK_ROWS}.0) AS BIGINT)) AS n_blocks FROM p
), r AS (
  SELECT d.*, w.weight, w.full_passes, w.rest, d.h % w.n_blocks AS block,
         CAST('0x' || substr(md5('{SEED}|' || d.k || '|' || (d.h % w.n_blocks)), 1, 15) AS BIGINT) AS block_h FROM d JOIN w USING (k)
), o AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY k ORDER BY block_h, block RANGE UNBOUNDED PRECEDING) AS block_upto,
         sum(n_tokens) OVER (PARTITION BY k, block_h, block) AS block_n,
         sum(n_tokens) OVER (PARTITION BY k, block_h, block ORDER BY h, doc_id) AS row_upto FROM r
), f AS (
  SELECT *, CASE WHEN rest > 0 AND (block_upto <= rest OR (block_upto - block_n <= rest AND block_upto - block_n + row_upto <= rest)) THEN 1 ELSE 0 END AS extra FROM o
)
SELECT doc_id, source, CAST(unnest(range(1, full_passes + extra + 1)) AS INTEGER) AS epoch, n_tokens, weight FROM f
"""
