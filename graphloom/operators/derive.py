"""Edges derived from the graph and its history (O-R rows, O-J13 to O-J16, O-A14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from graphloom.functions import paths, text
from graphloom.functions.shared import settle, stacked
from graphloom.model import CONTAINERS, Graph
from graphloom.operators.aggregates import representatives

#: Fixed values of name resolution.
AMBIGUOUS, COLLISION, UNSURE, ANCESTORS = 0.8, 0.3, 0.5, 16
VIEWS = ("erb",)
#: Files of a commit that are paired in one task (about).
PAIRED = 1000


def co_changes(commits: DataFrame, least: int = 3, most: int | None = None, block: int = PAIRED) -> DataFrame:
    """O-J13, O-A14: a, b, pairs, strength: pairs of files of different directories in one commit, against the busier file's commits.

    A commit's pairs grow with the square of its files; most, if given, leaves out bulk edits of more files. The files of a commit are dealt
    into blocks of about block, and pairs of blocks are joined, so that no task pairs a whole bulk commit; no pair is lost.
    """
    files = commits.select("commit_id", "path").distinct()
    per = files.groupBy("path").agg(F.count("*").alias("n"))
    if most is not None:
        files = files.join(files.groupBy("commit_id").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("commit_id"), "commit_id", "left_semi")
    blocks = files.groupBy("commit_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = files.join(blocks, "commit_id").withColumn("own", F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int"))
    dealt = dealt.select("commit_id", "path", paths.area(F.col("path")).alias("area"), "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    a = dealt.select("commit_id", F.col("path").alias("a"), F.col("area").alias("da"), F.col("own").alias("ba"), F.col("other").alias("bb"))
    b = dealt.select("commit_id", F.col("path").alias("b"), F.col("area").alias("db"), F.col("other").alias("ba"), F.col("own").alias("bb"))
    pairs = a.join(b, ["commit_id", "ba", "bb"]).where("a < b and da <> db").groupBy("a", "b").agg(F.count("*").alias("pairs")).where(F.col("pairs") >= least)
    out = pairs.join(per.select(F.col("path").alias("a"), F.col("n").alias("na")), "a").join(per.select(F.col("path").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", "pairs", F.round(F.col("pairs") / F.greatest("na", "nb"), 6).alias("strength"))


def temporal(g: Graph, commits: DataFrame) -> DataFrame:
    """O-R17: edges both ways between the representatives of files that change together."""
    file = g.files.select("file_id", "path").join(representatives(g), "file_id")
    side = lambda n: file.select(F.col("path").alias(n), F.col("symbol_id").alias(f"s_{n}"), F.col("file_id").alias(f"f_{n}"))
    pairs = co_changes(commits).join(side("a"), "a").join(side("b"), "b")
    row = lambda x, y: pairs.select(F.col(f"s_{x}").alias("source_id"), F.col(f"s_{y}").alias("target_id"), F.lit("temporal").alias("kind"), F.col(f"f_{x}").alias("file_id"), F.col("strength").alias("confidence"), F.col("pairs").cast("int").alias("co_changes"))
    return row("a", "b").unionByName(row("b", "a"))


def references(g: Graph) -> DataFrame:
    """O-R1: symbols as the resolver sees them."""
    s = g.symbols.join(g.files.select("file_id", "path", "language"), "file_id")
    return s.select("symbol_id", "name", "qualified", "kind", "file_id", "path", "language", "receiver" if "receiver" in g.symbols.columns else F.lit("").alias("receiver"), text.leaf(F.col("qualified")).alias("leaf"), paths.resolver_test(F.col("path")).alias("is_test"), paths.area(F.col("path")).alias("dir"))


def _allowed(found: DataFrame) -> DataFrame:
    """O-R7: one language on both sides (views and synthetic targets exempt), no production call into tests, and receivers of one kind if any agree."""
    gate = (F.col("language") == F.col("source_language")) | F.col("source_path").rlike(r"\.erb$") | text.is_synthetic(F.col("qualified"))
    found = found.where(gate & (F.col("source_is_test") | ~F.col("is_test")))
    fits = (F.col("want") == "") | (F.coalesce("receiver", F.lit("")) == F.col("want"))
    found = found.withColumn("fits", fits).withColumn("any_fits", F.max(fits.cast("int")).over(W.partitionBy("edge_no", "tier")))
    return found.where("any_fits = 0 or fits").drop("any_fits")


def _best(found: DataFrame, cap: float) -> DataFrame:
    """O-R8: the base confidence for one candidate, else the cap at most; same file first, then the smallest id. One row per edge by minimum."""
    pick = F.min(F.struct((F.col("file_id") != F.col("source_file_id")).alias("far"), "symbol_id"))["symbol_id"]
    one = found.groupBy("edge_no", "tier").agg(pick.alias("symbol_id"), F.count("*").alias("candidates"), F.first("base").alias("base"))
    return one.select("edge_no", "tier", "symbol_id", F.when(F.col("candidates") == 1, F.least(F.col("base"), F.lit(cap) if cap < 1 else F.col("base"))).otherwise(F.least(F.col("base"), F.lit(AMBIGUOUS))).alias("confidence"), (F.col("candidates") > 1).alias("ambiguous"))


def ancestry(g: Graph, depth: int = ANCESTORS) -> DataFrame:
    """O-R5: symbol_id, ancestor_id, depth: nearest first, over inherits and includes edges, a fixpoint of at most so many levels."""
    up = g.edges.where(F.col("kind").isin("inherits", "includes") & F.col("source_id").isNotNull()).select(F.col("source_id").alias("symbol_id"), F.col("target_id").alias("ancestor_id")).distinct()
    first = up.where("symbol_id <> ancestor_id").withColumn("depth", F.lit(1))
    # Only ancestors that have ancestors lead further; pairs with others are never written.
    end = lambda c: settle(up.select(F.col(c).alias("mid")).distinct(), "ids")
    mid = settle(end("ancestor_id").join(end("symbol_id"), "mid", "left_semi"), "inner")
    if mid.isEmpty():
        return first
    on = settle(up.withColumnRenamed("symbol_id", "mid").join(mid, "mid", "left_semi"), "parents")
    frontier = settle(first.join(mid.withColumnRenamed("mid", "ancestor_id"), "ancestor_id", "left_semi").select(*first.columns), "ancestry")
    near = settle(first.join(frontier.select("symbol_id").distinct(), "symbol_id", "left_semi").select(*first.columns), "ancestry")
    levels = [near]
    for d in range(2, depth + 1):
        step = frontier.select("symbol_id", F.col("ancestor_id").alias("mid")).join(on, "mid").select("symbol_id", "ancestor_id").distinct()
        new = settle(step.where("symbol_id <> ancestor_id").join(stacked(levels), ["symbol_id", "ancestor_id"], "left_anti").withColumn("depth", F.lit(d)), "ancestry")
        if new.isEmpty():
            break
        levels.append(new)
        frontier = new.join(mid.withColumnRenamed("mid", "ancestor_id"), "ancestor_id", "left_semi").select(*first.columns)
    return stacked([first, *levels[1:]])


def _leaf(p: DataFrame, refs: DataFrame) -> DataFrame:
    """O-R6 under the gates of O-R7 and the choice of O-R8, from counts: a common leaf name is counted once per language, receiver and kind
    of place, never paired with every reference to it. Receivers that agree are asked first, all of them next."""
    gates, every = ["language", "is_test", "synthetic"], "\x00"
    known = refs.withColumns({"synthetic": text.is_synthetic(F.col("qualified")), "to": F.coalesce("receiver", F.lit(""))})
    known = known.select("leaf", *gates, "file_id", "symbol_id", F.explode(F.array_distinct(F.array(F.col("to"), F.lit(every)))).alias("to"))
    counted = known.groupBy("leaf", "to", *gates).agg(F.count("*").alias("n"), F.min("symbol_id").alias("least"))
    near = known.groupBy("leaf", "to", F.col("file_id").alias("source_file_id")).agg(F.min("symbol_id").alias("near"))
    asked = F.array_compact(F.array(F.when(F.col("want") != "", F.struct(F.lit(0).alias("turn"), F.col("want").alias("to"))), F.struct(F.lit(1).alias("turn"), F.lit(every).alias("to"))))
    q = p.select("edge_no", F.col("leaf_wanted").alias("leaf"), "source_file_id", "source_language", "source_is_test", "source_path", "base", F.explode(asked).alias("q")).select("*", "q.turn", "q.to").drop("q")
    allowed = ((F.col("language") == F.col("source_language")) | F.col("source_path").rlike(r"\.erb$") | F.col("synthetic")) & (F.col("source_is_test") | ~F.col("is_test"))
    met = q.join(counted, ["leaf", "to"]).where(allowed).groupBy("edge_no", "turn", "leaf", "to", "source_file_id", "base").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    met = met.join(near, ["leaf", "to", "source_file_id"], "left").withColumn("symbol_id", F.coalesce("near", "least"))
    one = met.groupBy("edge_no").agg(F.min(F.struct("turn", "symbol_id", "n", "base")).alias("b")).select("edge_no", "b.*")
    confidence = F.when(F.col("n") > 1, F.lit(COLLISION)).otherwise(F.least(F.col("base"), F.lit(AMBIGUOUS)))
    return one.select("edge_no", F.lit(4).alias("tier"), "symbol_id", confidence.alias("confidence"), (F.col("n") > 1).alias("ambiguous"))


def resolve(g: Graph, pending: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """O-R2 to O-R8, O-J14, O-P7, O-R11: pending (edge_no, source_id, source_file_id, source_qualified, source_parent, target, kind, base, receiver)
    becomes (edge_no, source_id, target_id, kind, file_id, confidence, ambiguous, tier); edges without a target are left out.

    Every tier's candidates are joined on their own and the first tier that answers wins: qualified name, enclosing scopes (types only),
    ancestors' members, leaf name. A qualified name whose candidates the gates all reject ends the search; imports and includes stop there too.
    """
    refs = references(g)
    place = g.files.select(F.col("file_id").alias("source_file_id"), F.col("path").alias("source_path"), F.col("language").alias("source_language"), paths.resolver_test(F.col("path")).alias("source_is_test"))
    p = pending.join(place, "source_file_id").withColumns({"wanted": text.rewrite_receiver(F.col("target"), F.coalesce("source_parent", F.lit(""))), "want": F.coalesce("receiver", F.lit(""))}).drop("receiver")
    p = p.withColumn("leaf_wanted", text.leaf(F.col("wanted")))
    bare = F.col("wanted") == F.col("leaf_wanted")
    ungated = F.col("kind_p").isin("imports", "includes")
    exact = p.withColumnRenamed("kind", "kind_p").where(~((F.col("base") <= UNSURE) & bare)).join(refs, F.col("wanted") == F.col("qualified")).withColumn("tier", F.lit(1))
    named = exact.select("edge_no").distinct()
    first = exact.where(ungated).drop("fits").unionByName(_allowed(exact.where(~ungated)).drop("fits"))
    open_ = p.withColumnRenamed("kind", "kind_p").where(~ungated).join(named, "edge_no", "left_anti")
    scopes = F.split(F.regexp_replace("source_qualified", r"::|[#.\\]", "\x1f"), "\x1f")
    sep = F.when(F.col("source_qualified").contains("\\"), "\\").when(F.col("source_qualified").contains(".") & ~F.col("source_qualified").rlike("::|#"), ".").otherwise("::")
    prefix = F.transform(F.sequence(F.size(scopes), F.lit(1), F.lit(-1)), lambda k: F.concat(F.array_join(F.slice(scopes, F.lit(1), k), "\x1f"), F.lit("\x1f"), F.col("wanted")))
    lexical = open_.where(F.col("kind_p").isin("inherits", "composes")).withColumn("sep", sep).select("*", F.posexplode(prefix).alias("depth", "scoped"))
    lexical = lexical.withColumn("scoped", F.replace("scoped", F.lit("\x1f"), F.col("sep"))).join(refs.where(F.col("kind").isin(*CONTAINERS)), F.col("scoped") == F.col("qualified"))
    nearest = F.min("depth").over(W.partitionBy("edge_no"))
    lexical = _allowed(lexical.withColumn("tier", F.lit(2)).withColumn("near", nearest).where("depth = near")).drop("depth", "scoped", "sep", "near", "fits")
    parts = [first, lexical]
    if closure is not None:
        owner = g.symbols.select(F.col("symbol_id").alias("source_id"), F.col("parent_id").alias("owner"))
        members = refs.join(g.symbols.select("symbol_id", "parent_id").where("parent_id is not null"), "symbol_id")
        up = open_.where(F.col("kind_p").isin("calls", "tests", "references")).join(owner, "source_id").join(closure.select(F.col("symbol_id").alias("owner"), F.col("ancestor_id").alias("parent_id"), "depth"), "owner")
        inherited = up.join(members, (up.parent_id == members.parent_id) & (up.leaf_wanted == members.leaf)).drop("parent_id", "owner").withColumn("tier", F.lit(3))
        inherited = _allowed(inherited.withColumn("near", F.min("depth").over(W.partitionBy("edge_no"))).where("depth = near")).drop("depth", "near", "fits")
        parts.append(inherited)
    weak = _leaf(open_.where(F.col("kind_p").isin("calls", "tests", "references")), refs)
    common = first.columns
    strong = reduce(DataFrame.unionByName, (x.select(*common) for x in parts))
    every = _best(strong, 1.0).unionByName(weak)
    best = every.groupBy("edge_no").agg(F.min(F.struct("tier", "symbol_id", "confidence", "ambiguous")).alias("b")).select("edge_no", "b.*")
    return pending.select("edge_no", "source_id", "kind", F.col("source_file_id").alias("file_id")).join(best, "edge_no").select("edge_no", "source_id", F.col("symbol_id").alias("target_id"), "kind", "file_id", "confidence", "ambiguous", "tier")


def import_path(pending: DataFrame, modules: DataFrame, files: DataFrame) -> DataFrame:
    """O-R9: edge_no, dir or external: the longest module path that prefixes the import; a module path of two directories counts for none."""
    sure = modules.groupBy("module").agg(F.countDistinct("dir").alias("n"), F.min("dir").alias("dir")).where("n = 1").drop("n")
    parts = F.split("import_path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    tried = pending.select("edge_no", "import_path", F.explode(prefixes).alias("module")).join(sure, "module")
    best = tried.groupBy("edge_no", "import_path").agg(F.max(F.struct(F.length("module").alias("n"), "module", "dir")).alias("b"))
    rest = F.substring("import_path", F.length("b.module") + 2, F.length("import_path"))
    inside = best.select("edge_no", F.concat_ws("/", F.nullif(F.col("b.dir"), F.lit(".")), F.nullif(rest, F.lit(""))).alias("dir"))
    have = files.select(paths.area(F.col("path")).alias("dir")).distinct().withColumn("known", F.lit(True))
    return pending.select("edge_no").join(inside, "edge_no", "left").join(have, "dir", "left").select("edge_no", "dir", F.col("dir").isNull().alias("external"), F.coalesce("known", F.lit(False)).alias("known"))


def composed_models(found: DataFrame, model_modules: DataFrame) -> DataFrame:
    """O-R10: candidates (edge_no, symbol_id, module) of composes edges: those in model modules if any; an edge still ambiguous is refused."""
    m = found.join(model_modules.select("module").distinct().withColumn("model", F.lit(1)), "module", "left").withColumn("model", F.coalesce("model", F.lit(0)))
    top = m.withColumn("best", F.max("model").over(W.partitionBy("edge_no"))).where("model = best")
    return top.groupBy("edge_no").agg(F.min("symbol_id").alias("symbol_id"), F.count("*").alias("n")).where("n = 1").drop("n")


#: Pairs of a model and a part that a task makes, about.
EXPANDED = 1 << 22


def mixins(g: Graph) -> DataFrame:
    """O-R12, O-J16: callers of a macro compose its collaborators, .8. A macro is a callable that both is called by classes and composes."""
    use = g.edges.where("kind = 'calls' and source_id is not null").select(F.col("source_id").alias("model"), F.col("target_id").alias("macro"), "file_id").join(g.symbols.where("kind = 'class'").select(F.col("symbol_id").alias("model")), "model", "left_semi")
    use = settle(use.groupBy("model", "macro").agg(F.min("file_id").alias("file_id")), "uses")
    with_ = g.edges.where("kind = 'composes' and source_id is not null").select(F.col("source_id").alias("macro"), F.col("target_id").alias("part"))
    lists = settle(with_.groupBy("macro").agg(F.collect_set("part").alias("parts")), "collaborators")
    # Lists are dealt out by model, and made into pairs where they arrive: the pairs themselves are never shuffled.
    pairs = use.groupBy("macro").count().join(lists, "macro").agg(F.sum(F.col("count") * F.size("parts"))).first()[0] or 0
    dealt = use.join(lists, "macro").select("model", "file_id", "parts").repartition(max(1, -(-pairs // EXPANDED)), "model")
    met = dealt.select("model", "file_id", F.explode("parts").alias("part")).where("model <> part").groupBy("model", "part").agg(F.min("file_id").alias("file_id"))
    return met.select(F.col("model").alias("source_id"), F.col("part").alias("target_id"), F.lit("composes").alias("kind"), "file_id", F.lit(0.8).alias("confidence"))


def parent_links(children: DataFrame, g: Graph) -> DataFrame:
    """O-R13: children (symbol_id, file_id, parent_qualified) with their container: of the same file, else of the same directory; by path, line, id."""
    dirs = g.files.select("file_id", "path", paths.area(F.col("path")).alias("dir"))
    box = g.symbols.where(F.col("kind").isin(*CONTAINERS)).join(dirs, "file_id").select(F.col("symbol_id").alias("parent_id"), F.col("qualified").alias("parent_qualified"), F.col("file_id").alias("box_file"), "path", F.col("dir").alias("box_dir"), "line_start")
    c = children.join(dirs.select("file_id", "dir"), "file_id").join(box, "parent_qualified").where("parent_id <> symbol_id and (box_file = file_id or box_dir = dir)")
    order = F.struct((F.col("box_file") != F.col("file_id")).alias("far"), "path", "line_start", "parent_id")
    return c.groupBy("symbol_id").agg(F.min(order)["parent_id"].alias("parent_id"))


def satisfaction(methods: DataFrame, embeds: DataFrame, kinds: DataFrame, levels: int = 3, rounds: int = 1000) -> DataFrame:
    """O-R14, O-J15: interface_id, struct_id pairs of Go types, by relational division.

    methods: owner_id, name, params, results, known. embeds: outer_id, inner_id. kinds: symbol_id, kind ('interface' or else).
    Interfaces take over the methods of those they embed, to the fixpoint (an error beyond so many rounds); structs those of embedded types, three levels deep, unless their own
    or a nearer one has the name; methods promoted from two places at one depth are of unknown arity. Unknown arities fit any. Empty interfaces
    are skipped. Pairs are proposed by each interface's rarest method alone, then all its methods are compared.
    """
    iface = kinds.where("kind = 'interface'").select("symbol_id")
    owned = methods.select("owner_id", "name", "params", "results", "known").withColumn("depth", F.lit(0))

    def widened(rows: DataFrame, links: DataFrame, rounds: int, whole: bool) -> DataFrame:
        every = [frontier := settle(rows, "methods")]
        for d in range(1, rounds + 1):
            step = frontier.join(links, frontier.owner_id == links.inner_id).select(F.col("outer_id").alias("owner_id"), "name", "params", "results", "known", F.lit(d).alias("depth"))
            fresh = step.join(stacked(every).select("owner_id", "name"), ["owner_id", "name"], "left_anti").select(*rows.columns)
            one = fresh.groupBy("owner_id", "name").agg(F.min("params").alias("params"), F.min("results").alias("results"), (F.bool_and("known") & (F.countDistinct("params", "results") == 1)).alias("known"), F.min("depth").alias("depth"))
            frontier = settle(one.select(*rows.columns), "methods")
            if frontier.isEmpty():
                break
            every.append(frontier)
        else:
            if whole:
                raise RuntimeError(f"embedding goes on after {rounds} rounds")
        return stacked(every)

    i_links = embeds.join(iface.withColumnRenamed("symbol_id", "outer_id"), "outer_id", "left_semi")
    s_links = embeds.join(iface.withColumnRenamed("symbol_id", "outer_id"), "outer_id", "left_anti")
    i = widened(owned.join(iface.withColumnRenamed("symbol_id", "owner_id"), "owner_id", "left_semi"), i_links, rounds, True).drop("depth")
    s = widened(owned.join(iface.withColumnRenamed("symbol_id", "owner_id"), "owner_id", "left_anti"), s_links, levels, False).drop("depth")
    need = i.groupBy("owner_id").agg(F.count("*").alias("need")).select(F.col("owner_id").alias("interface_id"), "need")
    have = s.select(F.col("owner_id").alias("struct_id"), "name", F.col("params").alias("p"), F.col("results").alias("r"), F.col("known").alias("k"))
    fits = ~F.col("known") | ~F.col("k") | ((F.col("params") == F.col("p")) & (F.col("results") == F.col("r")))
    common = have.groupBy("name").agg(F.count("*").alias("owners"))
    rarest = i.join(common, "name", "left").groupBy(F.col("owner_id").alias("interface_id")).agg(F.min(F.struct(F.coalesce("owners", F.lit(0)), "name"))["name"].alias("name"))
    tried = rarest.join(have.select("struct_id", "name"), "name").select("interface_id", "struct_id")
    met = tried.join(i.withColumnRenamed("owner_id", "interface_id"), "interface_id").join(have, ["struct_id", "name"]).where(fits).groupBy("interface_id", "struct_id").agg(F.count("*").alias("met"))
    return met.join(need, "interface_id").where("met = need").select("interface_id", "struct_id", F.lit("inherits").alias("kind"), F.lit(0.9).alias("confidence"))


#: O-R15: how a test's path names what it tests (fixed values): pattern, replacement.
PAIRS = (
    (r"^(.*)_test\.go$", "$1.go"), (r"^spec/(.*)_spec\.rb$", "app/$1.rb"), (r"^test/(.*)_test\.rb$", "app/$1.rb"), (r"^(.*)_(?:test|spec)\.rb$", "$1.rb"), (r"^((?:.*/)?)test_([^/]*)\.py$", "$1$2.py"),
    (r"^(.*)_test\.py$", "$1.py"), (r"^(.*)\.(?:test|spec)\.([jt]sx?)$", "$1.$2"), (r"^(.*)Test\.(java|kt|php|scala)$", "$1.$2"),
)


def test_pairs(g: Graph) -> DataFrame:
    """O-R15: the earliest symbol of a test file tests every symbol of the file that its path names."""
    tried = F.array(*(F.when(F.col("path").rlike(p), F.regexp_replace("path", p, r)) for p, r in PAIRS))
    guess = g.files.select(F.col("file_id").alias("test_file"), F.explode(F.array_compact(tried)).alias("path")).join(g.files.select("file_id", "path"), "path").where("file_id <> test_file")
    first = g.symbols.groupBy(F.col("file_id").alias("test_file")).agg(F.min(F.struct("line_start", "symbol_id"))["symbol_id"].alias("source_id"))
    return guess.join(first, "test_file").join(g.symbols.select("file_id", F.col("symbol_id").alias("target_id")), "file_id").select("source_id", "target_id", F.lit("tests").alias("kind"), F.col("test_file").alias("file_id"), F.lit(0.8).alias("confidence")).distinct()


def naming_edges(g: Graph) -> DataFrame:
    """O-R16, O-P17: Ruby and Python role classes call the model that their prefix names, singular first, then as it is."""
    s = g.symbols.where(F.col("kind").isin("class", "module")).join(g.files.where(F.col("language").isin("ruby", "python")).select("file_id", "language"), "file_id")
    roles = s.withColumn("prefix", text.role_prefix(F.col("name"))).where("prefix <> ''")
    tried = roles.select(F.col("symbol_id").alias("source_id"), "file_id", "language", F.posexplode(F.array(text.singular(F.col("prefix")), F.col("prefix"))).alias("o", "model"))
    models = s.select(F.col("symbol_id").alias("target_id"), F.col("name").alias("model"), "language")
    best = tried.join(models, ["model", "language"]).where("source_id <> target_id").groupBy("source_id", "file_id").agg(F.min(F.struct("o", "target_id"))["target_id"].alias("target_id"))
    return best.select("source_id", "target_id", F.lit("calls").alias("kind"), "file_id", F.lit(0.6).alias("confidence"))


def name_sets(harvest: DataFrame) -> DataFrame:
    """O-R18, O-E10: language, set, names (sorted, distinct) of harvested (language, set, name)."""
    one = harvest.select("language", "set", "name").distinct()
    return one.groupBy("language", "set").agg(F.sort_array(F.collect_list("name")).alias("names"))
