"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words, so each of its documents is due the same fractional number of copies. The whole
part is certain. The fractional parts are rounded in pairs: of two documents, word mass moves at random from one to the other until one of
them has a whole number of copies, such that the expected copies of each stay what they were and the words of the pair stay exactly
the same. The document left over goes on to the next pair. Pairs are formed inside small blocks of a source, the leftovers of 64
blocks meet in a block of the next level, and so on: a reduction tree with log64(n) levels, each one a grouped aggregate. One document for each source
is left at the end and rounded to the nearer side, so the words taken miss the target by at most half of that one document.

Only DataFrame functions are used. Draws are hashes of the documents, so reruns and recomputed partitions agree. A hot source has more blocks, not larger ones.

Defined results: rows that agree in id, source, size and text are one unit whose copies are dealt evenly, so repeated rows stay spread; texts that are
NULL or have no words have size 0 and take no words; a NULL source is a source of its own, the last one; NULL ids are allowed; an empty
table gives an empty result; extra columns are ignored by ``mix_words`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyfield.llm.storage import kept

WORD = r"[^\x20\x09-\x0D]+"
FAN = 64
SEED = 20011
UNIT = ("doc_id", "source", "size", "text_key")
_ITEM = "struct<h:bigint,doc_id:bigint,text_key:binary,size:bigint,p:double>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a value inside an expression, so that it is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts, F.lit(SEED)), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def source_targets(units: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) for units(source, size, m).

    Weights repeat over the sources in code point order, NULL last. Filling all sources to the level ``lambda * weight``, none above ``most`` times its
    size, is what repeated resharing of the excess ends in; the level follows from running totals in order of
    capacity per weight. The windows run over one row for each source.
    """
    sizes = units.groupBy("source").agg(F.coalesce(F.sum(F.col("size") * F.col("m")), F.lit(0)).cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.row_number().over(every) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(at, F.lit(len(weights))) + 1)
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("q", F.col("cap") / F.col("w"))
    before = Window.orderBy("q", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level)
    reached = s.where(F.col("level") <= F.col("q")).agg(F.min_by("level", "q").alias("lam"))
    return (s.join(F.broadcast(reached)).withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("lam"), F.lit(0.0)) * F.col("w")))
            .select("source", "source_size", "n_units", "target"))


def _step(state: Column, x: Column) -> Column:
    """One pairing: the document carried along meets the next one; one of them becomes whole, the other is carried on."""
    def moved(item: Column, p: Column) -> Column:
        return F.struct(item["h"].alias("h"), item["doc_id"].alias("doc_id"), item["text_key"].alias("text_key"), item["size"].alias("size"), p.alias("p"))

    def result(done_item: Column, carried: Column) -> Column:
        return F.struct(F.concat(state["done"], F.array(done_item)).alias("done"), carried.alias("cur"))

    cur = state["cur"]
    one, zero = F.lit(1.0), F.lit(0.0)

    def pair(v: Column) -> Column:
        rise = v["up"] & (v["a_up"] <= v["b_down"])
        fall = ~v["up"] & (v["a_down"] <= v["b_up"])
        return (F.when(rise, result(moved(cur, one), moved(x, F.greatest(zero, x["p"] - v["a_up"] / x["size"]))))
                .when(v["up"], result(moved(x, zero), moved(cur, F.least(one, cur["p"] + v["b_down"] / cur["size"]))))
                .when(fall, result(moved(cur, zero), moved(x, F.least(one, x["p"] + v["a_down"] / x["size"]))))
                .otherwise(result(moved(x, one), moved(cur, F.greatest(zero, cur["p"] - v["b_up"] / cur["size"])))))

    amounts = F.struct((cur["size"] * (1 - cur["p"])).alias("a_up"), (cur["size"] * cur["p"]).alias("a_down"),
                       (x["size"] * x["p"]).alias("b_down"), (x["size"] * (1 - x["p"])).alias("b_up"))

    def choose(m: Column) -> Column:
        up, down = F.least(m["a_up"], m["b_down"]), F.least(m["a_down"], m["b_up"])
        draw = _uniform(cur["h"], x["h"]) * (up + down) < down
        return _let(F.struct(m["a_up"].alias("a_up"), m["a_down"].alias("a_down"), m["b_up"].alias("b_up"), m["b_down"].alias("b_down"), draw.alias("up")), pair)

    settled = (cur["p"] <= 0) | (cur["p"] >= 1)
    return (F.when(cur.isNull(), F.struct(state["done"].alias("done"), x.alias("cur")))
            .when(settled, result(cur, x))
            .otherwise(_let(amounts, choose)))


def _copies(units: DataFrame, targets: DataFrame) -> DataFrame:
    """units with ``copies`` (of all m rows together) and its source's size and target."""
    due = units.join(targets, units.source.eqNullSafe(targets.source)).drop(targets.source)
    total = F.col("m") * F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0))
    due = due.withColumn("whole", F.floor(F.coalesce(total, F.lit(0.0)) + F.lit(1e-9)).cast("long"))
    due = due.withColumn("p", F.greatest(F.lit(0.0), F.coalesce(total, F.lit(0.0)) - F.col("whole")))
    due = kept(due.withColumn("p", F.when(F.col("p") > 1e-9, F.col("p")).otherwise(F.lit(0.0)))
               .withColumn("h", F.xxhash64("doc_id", "text_key", "size", F.lit(SEED))), "mix-due")
    open_units = due.where("p > 0 and size > 0")
    item = F.struct("h", F.col("doc_id").cast("long").alias("doc_id"), "text_key", "size", "p")
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_units") / F.lit(FAN)))
    level = open_units.select("source", blocks.alias("blocks"), F.pmod(F.xxhash64("h", F.lit(7)), blocks).alias("block"), item.alias("item"))
    settled = []
    most = targets.agg(F.max("n_units").alias("n")).first().n or 0
    most = max(1, -(-most // FAN))
    while True:
        start = F.struct(F.array().cast(f"array<{_ITEM}>").alias("done"), F.lit(None).cast(_ITEM).alias("cur"))
        folded = (level.groupBy("source", "blocks", "block").agg(F.sort_array(F.collect_list("item")).alias("items"))
                  .select("source", "blocks", "block", F.aggregate("items", start, _step).alias("r")))
        folded = kept(folded, "mix-level")
        settled.append(folded.select("source", F.explode("r.done").alias("i")).select("source", "i.doc_id", "i.text_key", "i.size", (F.col("i.p") >= 1).alias("up")))
        rest = folded.select("source", F.ceil(F.col("blocks") / F.lit(FAN)).alias("blocks"), F.floor(F.col("block") / F.lit(FAN)).alias("block"), F.col("r.cur").alias("item"))
        if most == 1:
            break
        level, most = rest, -(-most // FAN)
    last = rest.where("item is not null").select("source", "item.doc_id", "item.text_key", "item.size", (F.col("item.p") >= 0.5).alias("up"))
    settled.append(last)
    settled.append(due.where("p > 0 and size = 0").select("source", F.col("doc_id").cast("long").alias("doc_id"), "text_key", "size", (_uniform(F.col("h"), F.lit(5)) < F.col("p")).alias("up")))
    ups = settled[0]
    for part in settled[1:]:
        ups = ups.union(part)
    ups = ups.where("up").select(*[F.col(c).alias(f"_{c}") for c in UNIT])
    same = [due["doc_id"].cast("long").eqNullSafe(ups["_doc_id"]), due["source"].eqNullSafe(ups["_source"]), due["size"] == ups["_size"], due["text_key"] == ups["_text_key"]]
    hit = due.join(ups, same, "left")
    return hit.select(*UNIT, "m", "source_size", "target", (F.col("whole") + F.col("_size").isNotNull().cast("long")).alias("copies"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"__size": size, "__key": F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))})


def _units(docs: DataFrame, weights, share, most) -> DataFrame:
    keyed = _keyed(docs).select("doc_id", "source", F.col("__size").alias("size"), F.col("__key").alias("text_key"))
    units = kept(keyed.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("m")), "mix-units")
    targets = kept(source_targets(units, weights, share, most), "mix-targets")
    return _copies(units, targets)


def mix_words(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for every row of docs(doc_id, source, text)."""
    row = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("k")
    rows = _units(docs, weights, share, most).select("*", row)
    copies = F.floor(F.col("copies") / F.col("m")).cast("long") + (F.col("k") < F.pmod(F.col("copies"), F.col("m"))).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as the mix takes it."""
    units = kept(_units(docs, weights, share, most).where("copies > 0").select(*[F.col(c).alias(f"__unit_{c}") for c in UNIT], F.col("copies").alias("__copies")), "mix-copies")
    one = _keyed(docs).dropDuplicates(["doc_id", "source", "__size", "__key"])
    same = [one["doc_id"].eqNullSafe(units["__unit_doc_id"]), one["__key"] == units["__unit_text_key"], one["source"].eqNullSafe(units["__unit_source"]),
            one["__size"] == units["__unit_size"]]
    return (one.join(units, same).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
            .select(*[one[c] for c in docs.columns]))
