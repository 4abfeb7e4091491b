"""The template that a vector is most like, by normalised correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Templates folded in one pass; more are taken in blocks of so many.
BLOCK = 256
#: Components of the part of a vector that is multiplied before the rest is bounded.
HEAD = 16
#: More than the sum of products can be off in doubles.
_SLACK = 1e-9


def normalised(vector: Column) -> Column:
    """Less its mean and of length 1; a vector whose components are all equal becomes all zeros."""
    doubles = vector.cast("array<double>")
    total = F.aggregate(doubles, F.lit(0.0), lambda a, v: a + v)
    centred = lambda v: F.transform(v, lambda x: x - total / F.size(v))
    shifted = centred(doubles)
    length = F.sqrt(F.aggregate(shifted, F.lit(0.0), lambda a, v: a + v * v))
    return F.when(F.size(vector) > 0, F.transform(F.array(F.struct(shifted.alias("v"), length.alias("n"))), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > _SLACK, x / s["n"]).otherwise(0.0)))[0])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)


def _parts(vector: Column, head: int) -> Column:
    """(head, tail, rest): the first components, the others, and the length of these."""
    first, others = F.slice(vector, F.lit(1), F.lit(head)), F.slice(vector, F.lit(head + 1), F.greatest(F.size(vector) - head, F.lit(0)))
    return F.struct(first.alias("head"), others.alias("tail"), F.sqrt(F.aggregate(others, F.lit(0.0), lambda a, v: a + v * v)).alias("rest"))


def best_templates(vectors: DataFrame, templates: DataFrame, head: int = HEAD, block: int = BLOCK) -> DataFrame:
    """(id, name, score, compared): of each vector (id, vector) the template (name, vector) of the greatest correlation, then of the least name.

    The product of two vectors is that of their heads and that of their tails, and the latter is no more than the product of the
    tails' lengths. Templates come in falling order of this bound, and once it lies below the best correlation so far the tails
    are not multiplied any more; compared counts those that were. Templates are a stated set, which every vector meets in blocks;
    null vectors and vectors of another size than all templates have no match and are left out, negative correlations count as 0.
    """
    known = templates.where("vector IS NOT NULL").select("name", F.size("vector").alias("size"), _parts(normalised(F.col("vector")), head).alias("p"))
    number = F.row_number().over(Window.partitionBy("size").orderBy("name")) - 1
    blocks = known.withColumn("block", F.floor(number / block)).groupBy("size", "block").agg(F.collect_list(F.struct("name", "p")).alias("templates"))  # `block` at most
    own = vectors.where("vector IS NOT NULL").select("id", F.size("vector").alias("size"), _parts(normalised(F.col("vector")), head).alias("p"))
    met = own.join(F.broadcast(blocks), "size") if templates.count() <= 100 * block else own.join(blocks, "size")
    heads = F.transform("templates", lambda t: F.struct(_dot(F.col("p.head"), t["p"]["head"]).alias("near"), t["name"].alias("name"), t["p"].alias("p")))
    bounded = F.transform(heads, lambda t: F.struct((-(t["near"] + F.col("p.rest") * t["p"]["rest"])).alias("bound"), t["name"].alias("name"), t["near"].alias("near"), t["p"]["tail"].alias("tail")))
    start = F.struct(F.lit(-2.0).alias("score"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("compared"))

    def better(best: Column, t: Column) -> Column:
        score = F.greatest(F.lit(0.0), t["near"] + _dot(F.col("p.tail"), t["tail"]))
        return F.transform(F.array(score), lambda s: F.when((s > best["score"]) | ((s == best["score"]) & (t["name"] < best["name"])), F.struct(s.alias("score"), t["name"].alias("name"), (best["compared"] + 1).alias("compared"))).otherwise(F.struct(best["score"].alias("score"), best["name"].alias("name"), (best["compared"] + 1).alias("compared"))))[0]

    # a bound below 0 counts as 0, as the correlation does
    folded = F.aggregate(F.array_sort(bounded), start, lambda best, t: F.when(F.greatest(F.lit(0.0), -t["bound"]) < best["score"] - _SLACK, best).otherwise(better(best, t)))
    found = met.select("id", folded.alias("b"))
    first = F.min(F.struct((-F.col("b.score")).alias("less"), F.col("b.name").alias("name")))
    return found.groupBy("id").agg(first.alias("m"), F.sum("b.compared").alias("compared")).select("id", "m.name", (-F.col("m.less")).alias("score"), "compared")
