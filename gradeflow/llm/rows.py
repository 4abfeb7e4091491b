"""Taking rows of a table by decisions made on (doc_id, hash of the text) or also on the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Broadcast decisions up to so many rows (16 bytes each).
MAX_BROADCAST = 100_000


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _keyed(docs: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """docs with a column of its own for each part of the key."""
    made = {"doc_id": F.col("doc_id").cast("long"), "text_hash": text_hash()}
    names = [fresh(docs, f"_key_{c}") for c in by]
    return docs.withColumns({n: made.get(c, F.col(c)) for n, c in zip(names, by, strict=True)}), names


def _met(names: list[str], by: list[str]) -> Column:
    out = F.lit(True)
    for n, c in zip(names, by, strict=True):
        out &= F.col(n).eqNullSafe(F.col(f"plan.{c}"))
    return out


def take(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of docs as often as plan (doc_id, text_hash, perhaps source, n, times) says, in all columns of docs.

    n is how many rows of docs have the key. The plan has a row for each key to keep; of several rows with one
    key the first by a hash of the whole row is taken, `times` times. Nulls in a key are values like others.
    """
    by = [c for c in plan.columns if c not in ("n", "times")]
    held, names = _keyed(docs, by)
    plan = plan.where("times > 0")
    met = held.join(plan.alias("plan"), _met(names, by)).withColumns({(n := fresh(docs, "_n")): F.col("plan.n"), (times := fresh(docs, "_times")): F.col("plan.times").cast("int")})
    met = met.select(*(F.col(f"`{c}`") for c in [*names, n, times]), F.struct(*(held[f"`{c}`"] for c in docs.columns)).alias(row := fresh(docs, "_row")))
    alone = met.where(F.col(n) == 1)
    if not plan.where("n > 1").isEmpty():
        first = Window.partitionBy(*names).orderBy(F.xxhash64(F.to_json(row)), F.to_json(row))
        alone = alone.unionByName(met.where(F.col(n) > 1).withColumn("at", F.row_number().over(first)).where("at = 1").drop("at"))
    again = alone.where(F.col(times) > 1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(times)))).drop("copy")
    return alone.where(F.col(times) == 1).unionByName(again).select(f"{row}.*")


def leave_out(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of docs whose (doc_id, text_hash) is not among keys; a null id is a value like others."""
    by = ["doc_id", "text_hash"]
    held, names = _keyed(docs, by)
    keys = keys.select(*by).distinct()
    small = keys.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    return held.join((F.broadcast(keys) if small else keys).alias("plan"), _met(names, by), "left_anti").select(*(f"`{c}`" for c in docs.columns))
