"""Impact analysis: reverse reachability with decaying confidence (O-G13 to O-G34, O-W4, O-W5)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions import paths
from graphloom.functions.shared import settle, stacked
from graphloom.model import FOLLOWED, Graph

#: Decay by kind, floor of stored edges, floor of structural kinds.
DECAY = {"inherits": 0.7, "composes": 0.5, "includes": 0.3, "tests": 0.5}
STRUCTURAL, STRUCTURAL_FLOOR, EDGE_FLOOR, FRONTIER = ("inherits", "composes", "includes"), 0.2, 0.1, 500


@dataclass(frozen=True)
class Options:
    """hops, least confidence, results; the presets of the three surfaces differ."""

    hops: int = 3
    confidence: float = 0.5
    cap: int = 100
    frontier: int = FRONTIER


ENGINE, TOOL, COMMAND = Options(), Options(5, 0.3, 200), Options(3, 0.7, 100)


def decay(kind: Column) -> Column:
    return reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), DECAY.items(), F.when(F.lit(False), 1.0)).otherwise(1.0)


def seeds(g: Graph, subjects: DataFrame) -> DataFrame:
    """O-G14: seed, symbol_id: the subject, its siblings (same qualified name and kind), and the members of classes and types."""
    s = g.symbols.select("symbol_id", "qualified", "kind", "parent_id")
    own = subjects.select(F.col("symbol_id").alias("seed")).join(s, F.col("seed") == F.col("symbol_id"))
    same = own.select("seed", "qualified", "kind").join(s.select("symbol_id", "qualified", "kind"), ["qualified", "kind"]).select("seed", "symbol_id", "kind")
    holders = same.where(F.col("kind").isin("class", "type")).select("seed", F.col("symbol_id").alias("parent_id"))
    members = holders.join(s.select("symbol_id", "parent_id"), "parent_id").select("seed", "symbol_id")
    return same.select("seed", "symbol_id").unionByName(members).distinct()


def reach(g: Graph, subjects: DataFrame, options: Options = ENGINE) -> DataFrame:
    """O-G13, O-G15 to O-G17, O-W4: seed, symbol_id, hop, confidence, via, kind; seeds themselves have hop 0.

    Each hop joins the frontier with inbound edges, multiplies confidences, keeps the best edge per node (non-temporal first, then
    confidence, then the smallest source and kind), and drops what has been visited. A node reached by temporal edges alone isn't followed.
    A frontier beyond its cap keeps the most confident, then the most depended on, then the smallest ids; what is cut stays undiscovered.
    Each hop joins the graph's own edges and writes what it discovers alone; dependants are counted once.
    """
    e = g.edges.where(F.col("kind").isin(*FOLLOWED["blast"]) & F.col("source_id").isNotNull() & (F.col("confidence") >= EDGE_FLOOR)).select("source_id", "target_id", "kind", F.col("confidence").alias("edge_confidence"))
    fan = settle(e.groupBy(F.col("target_id").alias("symbol_id")).agg(F.count("*").alias("fan")), "fan")
    first = seeds(g, subjects).select("seed", "symbol_id", F.lit(0).alias("hop"), F.lit(1.0).alias("confidence"), F.lit(None).cast("long").alias("via"), F.lit(None).cast("string").alias("kind"))
    hops = [frontier := settle(first, "reach")]
    for hop in range(1, options.hops + 1):
        step = frontier.select("seed", F.col("symbol_id").alias("target_id"), F.col("confidence").alias("path")).join(e, "target_id")
        cum = F.round(F.col("path") * F.col("edge_confidence") * decay(F.col("kind")), 12)
        floor = F.when(F.col("kind").isin(*STRUCTURAL), F.least(F.lit(STRUCTURAL_FLOOR), F.lit(options.confidence))).otherwise(options.confidence)
        step = step.withColumn("c", cum).where(F.col("c") >= floor)
        order = F.struct((F.col("kind") == "temporal").alias("t"), (-F.col("c")).alias("n"), F.col("target_id").alias("via"), F.col("kind").alias("kind"))
        best = step.groupBy("seed", F.col("source_id").alias("symbol_id")).agg(F.min(order).alias("b"))
        new = best.join(stacked(hops).select("seed", "symbol_id"), ["seed", "symbol_id"], "left_anti").select("seed", "symbol_id", F.lit(hop).alias("hop"), (-F.col("b.n")).alias("confidence"), "b.via", "b.kind")
        ranked = new.join(fan, "symbol_id", "left").withColumn("k", F.row_number().over(W.partitionBy("seed").orderBy(F.desc("confidence"), F.desc(F.coalesce("fan", F.lit(0))), "symbol_id")))
        new = settle(ranked.where(F.col("k") <= options.frontier).select("seed", "symbol_id", "hop", "confidence", "via", "kind"), "reach")
        if new.isEmpty():
            break
        hops.append(new)
        frontier = new.where("kind <> 'temporal'")
    return stacked(hops)


def affected(g: Graph, reached: DataFrame) -> DataFrame:
    """O-G18, O-G21, O-G34: what is reached beyond the seeds, direct or not, its tier, and whether it lies in a test."""
    named = reached.where("hop > 0").join(g.symbols.select("symbol_id", "qualified", "file_id", "parent_id"), "symbol_id").join(g.files.select("file_id", "path"), "file_id")
    tier = F.when(F.col("kind").isin("calls", "temporal", "references"), 1).when(F.col("kind") == "tests", 3).otherwise(2)
    return named.withColumns({"direct": F.col("hop") <= 1, "tier": tier, "is_test": paths.blast_test(F.col("path"))})


def without_members(rows: DataFrame, g: Graph) -> DataFrame:
    """O-G19: a module's or interface's own members don't count as affected by it."""
    subject = g.symbols.where(F.col("kind").isin("module", "interface")).select(F.col("symbol_id").alias("seed"), F.col("symbol_id").alias("parent_id"))
    return rows.join(subject, ["seed", "parent_id"], "left_anti").select(*rows.columns)


def capped(rows: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """O-W5: production first, then confidence, direct ones, dependants and id; at most cap per seed."""
    fan = edges.where("source_id is not null").groupBy(F.col("target_id").alias("symbol_id")).agg(F.count("*").alias("fan"))
    w = W.partitionBy("seed").orderBy("is_test", F.desc("confidence"), F.desc("direct"), F.desc(F.coalesce("fan", F.lit(0))), "symbol_id")
    return rows.join(fan, "symbol_id", "left").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).drop("fan")


def risk(rows: DataFrame) -> DataFrame:
    """O-G20, O-G34: per seed counts and the risk: ten direct callers high, three medium; a temporal one lifts low to medium."""
    direct, temporal = F.count_if("direct"), F.count_if(F.col("kind") == "temporal")
    level = F.when(direct >= 10, "high").when((direct >= 3) | (temporal > 0), "medium").otherwise("low")
    return rows.groupBy("seed").agg(direct.alias("direct"), F.count_if(~F.col("direct")).alias("indirect"), F.count_if("is_test").alias("in_tests"), F.count("*").alias("total"), level.alias("risk"))


def groups(rows: DataFrame, g: Graph) -> DataFrame:
    """O-G22, O-G26: subclasses and includers by how they were found; composers from the edge table, complete, one group per node."""
    found = rows.where(F.col("kind").isin("inherits", "includes")).select("seed", "symbol_id", F.when(F.col("kind") == "inherits", "subclasses").otherwise("via_includes").alias("group"))
    composed = g.edges.where("kind = 'composes' and source_id is not null").select(F.col("target_id").alias("seed"), F.col("source_id").alias("symbol_id")).distinct()
    composed = composed.join(rows.select("seed").distinct(), "seed", "left_semi").join(found.select("seed", "symbol_id"), ["seed", "symbol_id"], "left_anti")
    return found.unionByName(composed.withColumn("group", F.lit("via_composition")))


def affected_tests(g: Graph, reached: DataFrame) -> DataFrame:
    """O-G23: seed, path of the files of tests edges into anything reached; a file-level edge counts by its own file."""
    t = g.edges.where("kind = 'tests'").join(g.symbols.select(F.col("symbol_id").alias("source_id"), F.col("file_id").alias("source_file")), "source_id", "left")
    t = t.select(F.col("target_id").alias("symbol_id"), F.coalesce("source_file", "file_id").alias("file_id"))
    return reached.select("seed", "symbol_id").join(t, "symbol_id").join(g.files.select("file_id", "path"), "file_id").select("seed", "path").distinct()


def importers(g: Graph, reached: DataFrame, most: int = 24) -> DataFrame:
    """O-G24: per seed the files with imports edges into it whose symbols weren't reached: their count, and the list unless longer than most."""
    subject = reached.where("hop = 0").select("seed", F.col("symbol_id").alias("target_id"))
    into = g.edges.where("kind = 'imports'").join(subject, "target_id").select("seed", "file_id").distinct()
    done = reached.where("hop > 0").join(g.symbols.select("symbol_id", "file_id"), "symbol_id").select("seed", "file_id").distinct()
    rest = into.join(done, ["seed", "file_id"], "left_anti").join(g.files.select("file_id", "path"), "file_id")
    counted = rest.groupBy("seed").agg(F.count("*").alias("importers"))
    few = rest.join(counted.where(F.col("importers") <= most).select("seed"), "seed", "left_semi").groupBy("seed").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return counted.join(few, "seed", "left")


def view_reached(g: Graph, subjects: DataFrame) -> DataFrame:
    """O-G25, O-Q6: subjects with a call or reference from a template file."""
    views = g.files.where(F.col("path").endswith(".erb")).select("file_id")
    e = g.edges.where(F.col("kind").isin("calls", "references")).join(views, "file_id", "left_semi")
    return subjects.select("symbol_id").join(e.select(F.col("target_id").alias("symbol_id")), "symbol_id", "left_semi")


def parents(rows: DataFrame, g: Graph) -> DataFrame:
    """O-G27: parents of affected symbols that aren't affected themselves, as direct callers. The total stays the count before the cap plus these."""
    p = rows.where("parent_id is not null").select("seed", F.col("parent_id").alias("symbol_id")).distinct()
    return p.where("symbol_id <> seed").join(rows.select("seed", "symbol_id"), ["seed", "symbol_id"], "left_anti")


def merged(rows: DataFrame, risks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-G33: over all seeds of a diff the union of affected symbols, nearest and surest, and the worst risk."""
    union = rows.groupBy("symbol_id").agg(F.min("hop").alias("hop"), F.max("confidence").alias("confidence"), F.count("*").alias("seeds"))
    worst = risks.agg(F.max(F.when(F.col("risk") == "high", 2).when(F.col("risk") == "medium", 1).otherwise(0)).alias("r"))
    return union, worst.select(F.get(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("r")).alias("risk"))


# --- Retention: who keeps a value of the subject alive ------------------------------------------------------------------------------


def carriers(g: Graph, subjects: DataFrame) -> DataFrame:
    """O-G28, O-G31: seed, symbol_id, level, chain: fixpoint over inbound composes and includes edges, interfaces left out, smallest parents.

    Every carrier is found, at whatever level: a level that finds none that is new ends it, so cycles do too.
    """
    usable = g.symbols.where("kind <> 'interface'").select(F.col("symbol_id").alias("source_id"))
    e = g.edges.where(F.col("kind").isin("composes", "includes") & F.col("source_id").isNotNull()).join(usable, "source_id", "left_semi").select("source_id", "target_id").distinct()
    e = settle(e, "edges")
    found = [frontier := settle(subjects.select(F.col("symbol_id").alias("seed"), "symbol_id", F.lit(0).alias("level"), F.array("symbol_id").alias("chain")), "carriers")]
    for level in count(1):
        step = frontier.select("seed", F.col("symbol_id").alias("target_id"), "chain").join(e, "target_id")
        best = step.groupBy("seed", F.col("source_id").alias("symbol_id")).agg(F.min(F.struct("target_id", "chain")).alias("b"))
        new = best.join(stacked(found).select("seed", "symbol_id"), ["seed", "symbol_id"], "left_anti").select("seed", "symbol_id", F.lit(level).alias("level"), F.concat("b.chain", F.array("symbol_id")).alias("chain"))
        frontier = settle(new, "carriers")
        if frontier.isEmpty():
            break
        found.append(frontier)
    return stacked(found)


def junk_interfaces(g: Graph, most: int = 25) -> DataFrame:
    """O-G30: interfaces with a single method whose name more than most methods share."""
    m = g.symbols.where("kind = 'method'").select("name", "parent_id")
    i = g.symbols.where("kind = 'interface'").select(F.col("symbol_id").alias("parent_id"))
    one = m.join(i, "parent_id", "left_semi").select("parent_id", "name").distinct().groupBy("parent_id").agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n = 1")
    common = m.groupBy("name").agg(F.count("*").alias("uses")).where(F.col("uses") > most)
    return one.join(common, "name").select(F.col("parent_id").alias("symbol_id"))


def laundered(g: Graph, found: DataFrame) -> DataFrame:
    """O-G29, O-A16, O-G32: holders of interfaces that carriers satisfy: seed, holder, smallest interface and carrier, production first."""
    tests = g.files.where(paths.blast_test(F.col("path"))).select("file_id")
    inherit = g.edges.where("kind = 'inherits' and source_id is not null").join(tests, "file_id", "left_anti")
    via = found.select("seed", F.col("symbol_id").alias("source_id")).join(inherit.select("source_id", "target_id"), "source_id").join(junk_interfaces(g).withColumnRenamed("symbol_id", "target_id"), "target_id", "left_anti")
    via = via.groupBy("seed", F.col("target_id").alias("via")).agg(F.min("source_id").alias("carrier"))
    hold = g.edges.where(F.col("kind") == "composes").where("source_id is not null").select(F.col("target_id").alias("via"), F.col("source_id").alias("symbol_id"))
    held = via.join(hold, "via").groupBy("seed", "symbol_id").agg(F.min(F.struct("via", "carrier")).alias("b")).select("seed", "symbol_id", "b.via", "b.carrier")
    held = held.join(found.select("seed", "symbol_id"), ["seed", "symbol_id"], "left_anti")
    place = held.join(g.symbols.select("symbol_id", "file_id"), "symbol_id").join(g.files.select("file_id", "path"), "file_id").withColumn("is_test", paths.blast_test(F.col("path")))
    return place.withColumn("rank", F.row_number().over(W.partitionBy("seed").orderBy("is_test", "symbol_id"))).drop("file_id")
