"""Mixing sources to target weights by pivotal rounding. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayread.llm.common import WORD, draw, free, settle

#: Units that one node of the reduction tree takes on average.
FAN_IN = 128


def targets(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources`` (source, source_size), one row each -> with ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and divide ``share`` of all sizes. A target stops at
    ``most`` times its source's size; what is over goes to the others by weight until none is above. That fixed point is a
    water level: with sources in order of cap per weight, the first one whose cap lies over the level of the rest sets it.
    The windows see one row per source. Without sources or words every target is 0.
    """
    kinds = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("per", "place").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("per", "place").rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % kinds + 1).cast("int"))
    rows = (
        sources.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("per", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("water", F.min(F.when(F.col("per") > F.col("level"), F.struct("per", "place", "level"))).over(every))
    )
    return rows.select("source", "source_size", F.when(F.col("water").isNull() | (F.col("per") < F.col("water.per")), F.col("cap"))
                       .otherwise(F.least("cap", F.col("water.level") * F.col("weight"))).alias("target"))


def _pivot(units: Column, seed: int, also: tuple[tuple[str, str], ...] = ()) -> Column:
    """Sequential pivotal steps over an array of units (size, doc_id, turn, p, ``also``): the open unit and what was decided.

    What moves between two units is mass in words: one rises by it and the other falls by it until either reaches 0 or 1
    and is settled. The draw between the two directions keeps both expectations, and the words in sum do not change.
    """
    unit = "struct<size:bigint,doc_id:bigint,turn:bigint,p:double" + "".join(f",{n}:{t}" for n, t in also) + ">"
    start = F.struct(F.lit(None).cast(unit).alias("open"), F.expr(f"cast(array() as array<{unit}>)").alias("done"))

    def give(x: Column, p: Column) -> Column:
        return F.struct(*[x[n].alias(n) for n in ("size", "doc_id", "turn")], p.cast("double").alias("p"), *[x[n].alias(n) for n, _ in also])

    def step(state: Column, y: Column) -> Column:
        x = state["open"]
        x_room, x_mass = (1 - x["p"]) * x["size"], x["p"] * x["size"]
        y_room, y_mass = (1 - y["p"]) * y["size"], y["p"] * y["size"]
        up, down = F.least(x_room, y_mass), F.least(x_mass, y_room)  # what x can gain from y, and lose to it
        rise = (up + down <= 0) | (draw(x["doc_id"], x["turn"], y["doc_id"], y["turn"], seed=seed) * (up + down) < down)
        settle_x = F.when(rise, x_room <= y_mass).otherwise(x_mass <= y_room)
        moved = F.when(rise, up).otherwise(-down)
        end = F.when(rise == settle_x, 1.0).otherwise(0.0)
        clip = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        opened = F.when(settle_x, give(y, clip(y["p"] - moved / y["size"]))).otherwise(give(x, clip(x["p"] + moved / x["size"])))
        closed = F.when(settle_x, give(x, end)).otherwise(give(y, end))
        return F.when(x.isNull(), F.struct(give(y, y["p"]).alias("open"), state["done"].alias("done"))).otherwise(
            F.struct(opened.alias("open"), F.concat(state["done"], F.array(closed)).alias("done")))

    return F.aggregate(units, start, step)


def pivotal(units: DataFrame, seed: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """``units`` (doc_id, turn, source, size: long, p in [0, 1)) -> (doc_id, source, size, take, 0 or 1).

    A reduction tree in which a node holds about ``fan_in`` units, dealt out by a hash and never by source alone, so a
    hot source fills many nodes. The lowest nodes hold units of one source and nearly one size, so that few words move far.
    Each node settles all its units but one and passes that one up. What a source has open at its root is closed by
    ``_closed``, so that whole units are taken. Units without words move nothing and are settled by a draw of their own.
    """
    spread = F.pmod(F.xxhash64("doc_id", "turn", F.lit(seed)), F.lit(1 << 30))
    kind = F.floor(F.log2(F.col("size") + 1.0) * 8)
    rows = units.select("doc_id", "turn", "source", "size", "p", kind.alias("kind"))
    out = lambda take: ("doc_id", "source", "size", take.cast("double").alias("take"))
    decided = [rows.where("p <= 0").select(*out(F.lit(0))),
               rows.where("p > 0 and size <= 0").select(*out((draw("doc_id", "turn", seed=seed + 1000) < F.col("p")).cast("int")))]
    rows = rows.where("p > 0 and size > 0")
    counts = settle(rows.groupBy("source", "kind").agg(F.count("*").alias("n")))
    largest = counts.agg(F.max("n")).first()[0] or 1
    depth = max(1, math.ceil(math.log(max(largest, 2), fan_in)))
    for level in range(depth, -1, -1):
        if level:
            nodes = F.ceil(F.col("n") / F.lit(float(fan_in)) ** F.lit(depth - level + 1)).cast("long")
            c = counts.select(F.col("source").alias("s"), F.col("kind").alias("k"), nodes.alias("nodes"))
            rows = rows.join(c, F.col("source").eqNullSafe(F.col("s")) & (F.col("kind") == F.col("k"))).withColumn("node", spread % F.col("nodes"))
        keys = ["source", "kind", "node"] if level else ["source"]
        held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "turn", "p"))).alias("held"))
        held = settle(held.select(*keys, _pivot(held.held, seed + level).alias("state")))
        if level:
            done = held.select("source", F.explode("state.done").alias("d")).select("source", "d.*")
            decided.append(done.select(*out(F.col("p"))))
            rows = held.select("state.open.*", "source", "kind")
    decided.append(_closed(held, seed, fan_in).select(*out(F.col("p"))))
    whole = decided[0]
    for part in decided[1:]:
        whole = whole.union(part)
    return whole


def _ends(opened: Column, done: Column, seed: int) -> Column:
    """The two ways of closing a source that come nearest to its words, from below and from above: struct (low, high).

    A way takes the open unit or not, and turns none, one or two of the units that the root has settled. ``words`` are
    those it adds; of ways with equal words the one that turns fewest holds, then a seeded draw. The root settles about one
    unit for each size class, so pairs are few.
    """
    at = F.transform(done, lambda x, k: F.struct(F.when(x["p"] > 0.5, -x["size"]).otherwise(x["size"]).alias("words"), k.alias("k")))
    at = F.concat(F.array(F.struct(F.lit(0).cast("bigint").alias("words"), F.lit(-1).alias("k"))), at)
    turned = F.flatten(F.transform(at, lambda x: F.transform(
        F.filter(at, lambda y: (y["k"] > x["k"]) | (y["k"] == -1) & (x["k"] == -1)),
        lambda y: F.struct((x["words"] + y["words"]).alias("words"), x["k"].alias("i"), y["k"].alias("j")))))
    ways = F.flatten(F.transform(F.array(F.lit(0), F.lit(1)), lambda take: F.transform(turned, lambda t: F.struct(
        (t["words"] + take * opened["size"]).alias("words"),
        ((t["i"] >= 0).cast("int") + (t["j"] >= 0).cast("int")).alias("turns"),
        draw(opened["doc_id"], opened["turn"], take, t["i"], t["j"], seed=seed).alias("lot"), take.alias("take"), t["i"].alias("i"), t["j"].alias("j")))))
    mass = opened["p"] * opened["size"]
    below = F.filter(ways, lambda w: w["words"] <= mass + 1e-6)
    above = F.filter(ways, lambda w: w["words"] >= mass - 1e-6)
    fewest = F.transform(below, lambda w: F.struct(w["words"].alias("words"), (-w["turns"]).alias("turns"), *[w[n].alias(n) for n in ("lot", "take", "i", "j")]))
    return F.struct(
        F.array_max(fewest).alias("low"),
        F.array_min(above).alias("high"))


def _closed(held: DataFrame, seed: int, fan_in: int) -> DataFrame:
    """``held`` (source, state) of the sources' roots -> (source, size, doc_id, turn, p), p 0 or 1.

    Each source can end a little under or over its words (``_ends``). What lies between is a unit of its own, and these
    units are rounded against each other by pivotal steps over all sources, so the words in sum stay what they were; the
    one that is left open in the end is drawn.
    """
    kind = dict(held.dtypes)["source"]
    ends = settle(held.select("source", "state", _ends(F.col("state.open"), F.col("state.done"), seed + 2000).alias("ends")))
    low, high = F.col("ends.low.words"), F.col("ends.high.words")
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("state.open.p") * F.col("state.open.size") - low) / (high - low)))
    rows = settle(ends.where(low < high).select((high - low).alias("size"), "state.open.doc_id", "state.open.turn", p.alias("p"), "source"))
    n, level, over = rows.count(), 0, []
    while n > 1:
        nodes = -(-n // fan_in)
        node = F.pmod(F.xxhash64("source", F.lit(seed + 3000 + level)), F.lit(nodes))
        nodes = rows.groupBy(node.alias("node")).agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "turn", "p", "source"))).alias("held"))
        nodes = settle(nodes.select(_pivot(nodes.held, seed + 3000 + level, (("source", kind),)).alias("state")))
        over.append(nodes.select(F.explode("state.done").alias("d")).select("d.source", F.col("d.p") > 0.5))
        rows, level = nodes.select("state.open.*"), level + 1
        n = rows.count()
    last = rows.select("source", draw("doc_id", "turn", seed=seed + 4000) < F.col("p"))
    for part in over:
        last = last.union(part)
    last = settle(last.toDF("s", "over"))
    way = F.when(F.col("over"), F.col("ends.high")).otherwise(F.col("ends.low"))
    ended = ends.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "state", way.alias("way"))
    units = F.concat(
        F.transform("state.done", lambda x, k: x.withField("p", F.when((k == F.col("way.i")) | (k == F.col("way.j")), 1 - x["p"]).otherwise(x["p"]))),
        F.array(F.col("state.open").withField("p", F.col("way.take").cast("double"))))
    return ended.select("source", F.explode(units).alias("u")).select("source", "u.*")


def copies(documents: DataFrame, seed: int = 0, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5,
           most: float = 2.0) -> DataFrame:
    """``documents`` (doc_id, text, source) -> doc_id, size, source_size, target, source, copies, taken.

    A document's expected copies are target / source_size: the whole part is taken as it is, the fraction is rounded by
    ``pivotal`` to none or one more. Only whole copies are taken: ``taken``, in words, is ``copies`` times the size. A source
    of few documents can miss its target by up to one of them; what one misses others take more of, so the sum of all
    sources is kept to one document. Every row counts, repeated ids and null ids too. Null and empty texts have size 0 and
    get copies like any other, which take no words. Other columns are not looked at. Reruns over the same rows agree, for all draws go by
    ids, sizes and the seed; rows that are equal in both are alike. An empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = settle(documents.select(F.col("doc_id").cast("long"), "source", size.alias("size")))
    goals = settle(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    goals = goals.select(F.col("source").alias("s"), "source_size", "target",
                         F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    # a repeated row becomes units of its own
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times"))
    units = alike.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("turn"))
    units = units.join(goals, F.col("source").eqNullSafe(F.col("s")))
    taken = pivotal(units.select("doc_id", "turn", "source", "size", (F.col("rate") - F.floor("rate")).alias("p")), seed)
    number = (F.floor("rate") + F.col("take")).cast("long")
    return taken.join(goals, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", "source", number.alias("copies"), (number * F.col("size")).alias("taken"))


def mixed(documents: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: rows of ``documents``, whose ids are unique, as often as ``copies`` says. All columns stay."""
    names = documents.columns
    held, times, turn = (free(name, names) for name in ("key_", "copies_", "turn_"))
    plan = copies(documents, **options).where("copies > 0").select(F.col("doc_id").alias(held), F.col("copies").alias(times))
    rows = documents.join(plan, F.col(f"`{key}`").eqNullSafe(F.col(held)))
    rows = rows.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return rows.select(*[F.col(f"`{c}`") for c in names])
