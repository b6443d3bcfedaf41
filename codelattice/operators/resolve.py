"""Name resolution joins: symbols, imports, modules, aliases, export keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from codelattice.functions.paths import file_of
from codelattice.model import CodeGraph
from codelattice.session import FEW_ROWS, shuffled, stage

PYTHON_SUFFIXES = (".py", "/__init__.py")
SCRIPT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".vue")


def resolve_same_file(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Bare CALLS targets become the first definition of that name in the file."""
    defs = (
        nodes.where(F.col("kind").isin("Function", "Class", "Type", "Test"))
        .groupBy("file_path", F.col("name").alias("target"))
        .agg(F.min_by("qualified_name", F.struct("line_start", "qualified_name")).alias("local"))
    )
    bare = (F.col("kind") == "CALLS") & ~F.col("target").contains("::")
    return edges.join(defs, ["file_path", "target"], "left").select(
        "kind", "source",
        F.when(bare & F.col("local").isNotNull(), F.col("local")).otherwise(F.col("target")).alias("target"),
        "file_path", "line",
    )


def resolve_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, module, resolved) by language rules, NULL when nothing fits.

    Each import yields its candidate paths with a preference rank; the file
    list decides by an equi-join and the least rank.
    """
    rows = imports.select("file_path", "module", "language").distinct()
    folder = F.regexp_replace("file_path", "(^|/)[^/]*$", "")
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    # Ancestors from the file's own directory up to the root.
    ups = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/"),
    )
    dotted = F.replace(F.col("module"), F.lit("."), F.lit("/"))
    python = F.flatten(F.transform(
        ups,
        lambda d: F.array(*[
            F.concat(F.when(d == "", "").otherwise(F.concat(d, F.lit("/"))), dotted, F.lit(s)) for s in PYTHON_SUFFIXES
        ]),
    ))
    base = F.concat(F.when(folder == "", F.lit("")).otherwise(F.concat(folder, F.lit("/"))), F.col("module"))
    # Columns of their own, so the path clean-up runs once per import.
    rows = rows.withColumn("plain", _collapse(base)).withColumn("stem", F.regexp_replace("plain", r"\.[^./]*$", ""))
    plain, stem = F.col("plain"), F.col("stem")
    script = F.array(
        plain, *[F.concat(stem, F.lit(s)) for s in SCRIPT_SUFFIXES],
        *[F.concat(plain, F.lit("/index" + s)) for s in SCRIPT_SUFFIXES],
    )
    dart = F.array(plain, F.concat(stem, F.lit(".dart")))
    relative = F.col("module").startswith(".")
    options = (
        F.when(F.col("language") == "python", python)
        .when(F.col("language").isin("javascript", "typescript", "tsx", "vue") & relative, script)
        .when((F.col("language") == "dart") & relative, dart)
    )
    found = (
        rows.select("file_path", "module", "language", F.posexplode(options).alias("rank", "path"))
        .join(files.select(F.col("file_path").alias("path")).distinct(), "path")
        .groupBy("file_path", "module", "language").agg(F.min_by("path", "rank").alias("resolved"))
    )
    return rows.drop("plain", "stem").join(found, ["file_path", "module", "language"], "left")


def _collapse(path):
    """Drop ``.`` parts and fold every ``name/..`` pair, however deep."""
    last = lambda done: F.try_element_at(done, F.lit(-1))

    def step(done, part):
        folds = (part == "..") & F.coalesce(~last(done).isin("", ".."), F.lit(False))
        return F.when(part == ".", done).when(folds, F.slice(done, 1, F.size(done) - 1)).otherwise(F.array_append(done, part))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.regexp_replace(F.array_join(parts, "/"), "/$", "")


def resolve_aliases(imports: DataFrame, aliases: DataFrame, files: DataFrame) -> DataFrame:
    """Path aliases of the nearest configuration, longest literal prefix first.

    ``aliases``: config_dir, pattern, target (relative to the base directory),
    base_dir. A ``*`` in the pattern is substituted into the target.
    """
    rows = imports.where(~F.col("module").startswith(".")).select("file_path", "module").distinct()
    folder = F.regexp_replace("file_path", "(^|/)[^/]*$", "")
    parts = F.split(folder, "/")
    near = rows.select(
        "file_path", "module",
        F.posexplode(F.transform(
            F.sequence(F.lit(0), F.size(parts)),
            lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/"),
        )).alias("up", "config_dir"),
    )
    owner = (
        near.join(aliases.select("config_dir").distinct(), "config_dir")
        .groupBy("file_path", "module").agg(F.min_by("config_dir", "up").alias("config_dir"))
    )
    star = F.instr("pattern", "*")
    head = F.when(star > 0, F.expr("substring(pattern, 1, instr(pattern, '*') - 1)")).otherwise(F.col("pattern"))
    tail = F.when(star > 0, F.expr("substring(pattern, instr(pattern, '*') + 1)")).otherwise(F.lit(""))
    wild = star > 0
    fits = F.when(
        wild,
        F.col("module").startswith(head) & F.col("module").endswith(tail)
        & (F.length("module") >= F.length(head) + F.length(tail)),
    ).otherwise(F.col("module") == F.col("pattern"))
    rest = F.col("module").substr(F.length(head) + 1, F.length("module") - F.length(head) - F.length(tail))
    hit = owner.join(aliases, "config_dir").where(fits)
    place = F.when(F.coalesce("base_dir", F.lit("")) == "", F.lit("")).otherwise(F.concat("base_dir", F.lit("/")))
    filled = F.when(wild, F.replace(F.col("target"), F.lit("*"), rest)).otherwise(F.col("target"))
    hit = hit.withColumn("plain", _collapse(F.concat(place, filled)))
    plain = F.col("plain")
    options = F.array(
        plain, *[F.concat(plain, F.lit(s)) for s in SCRIPT_SUFFIXES],
        *[F.concat(plain, F.lit("/index" + s)) for s in SCRIPT_SUFFIXES],
    )
    return (
        hit.select("file_path", "module", (-F.length(head)).alias("prefix"), "pattern", "target",
                   F.posexplode(options).alias("rank", "path"))
        .join(files.select(F.col("file_path").alias("path")).distinct(), "path")
        .groupBy("file_path", "module")
        .agg(F.min_by("path", F.struct("prefix", "pattern", "target", "rank")).alias("resolved"))
    )


def resolve_imported(edges: DataFrame, import_names: DataFrame, modules: DataFrame) -> DataFrame:
    """Bare calls of imported names become ``resolved file::name``.

    ``import_names``: file_path, name, module. ``modules``: the result of
    ``resolve_modules``.
    """
    where = (
        import_names.join(modules.where(F.col("resolved").isNotNull()), ["file_path", "module"])
        .groupBy("file_path", F.col("name").alias("target")).agg(F.max("resolved").alias("resolved"))
    )
    bare = (F.col("kind") == "CALLS") & ~F.col("target").contains("::")
    return edges.join(where, ["file_path", "target"], "left").select(
        "kind", "source",
        F.when(bare & F.col("resolved").isNotNull(), F.concat("resolved", F.lit("::"), "target"))
        .otherwise(F.col("target")).alias("target"),
        "file_path", "line",
    )


def tested_by_edges(nodes: DataFrame, edges: DataFrame, test_file) -> DataFrame:
    """Production → test edges for calls out of test symbols in test files."""
    tests = nodes.where("is_test").where(F.col("kind") != "File").select(F.col("qualified_name").alias("source"))
    return (
        edges.where((F.col("kind") == "CALLS") & test_file(F.col("file_path")))
        .join(tests, "source", "left_semi")
        .select(F.lit("TESTED_BY").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"),
                "file_path", "line")
    )


def export_keys(g: CodeGraph) -> DataFrame:
    """Short keys a node answers to: name, file::name, dotted module, path suffixes."""
    qn, path = F.col("qualified_name"), F.col("file_path")
    module = F.replace(F.replace(path, F.lit("/"), F.lit(".")), F.lit(".py"), F.lit(""))
    parts = F.split(path, "/")
    tails = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"),
    )
    keys = F.when(F.col("kind") == "File", F.concat(F.array(F.col("name"), module), tails)).otherwise(
        F.array(F.col("name"), F.element_at(F.split(qn, "/"), -1), F.concat(module, F.lit("."), F.col("name")))
    )
    return g.nodes.select(
        F.explode(F.filter(F.array_distinct(keys), lambda k: k != "")).alias("key"), "qualified_name", "file_path"
    )


def _counted(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
    seen = Observation()
    return stage(rows.observe(seen, *(c.alias(k) for k, c in counts.items())), name), seen.get


def _sized(rows: DataFrame, count: int) -> DataFrame:
    return rows if count <= FEW_ROWS else shuffled(rows)


def resolve_for_export(g: CodeGraph) -> DataFrame:
    """Edges with both ends resolved to nodes; unresolvable edges are dropped.

    Ambiguous keys prefer the only candidate of the source's file, then the
    only one below its directory, then the first. Candidates are counted per
    key, (key, file) and (key, directory), so no pair list of a common name
    is ever built. Ends that are no node are looked up once per name and kept;
    edges meet only those, and not at all where a side has none.
    """
    index = export_keys(g)
    pick = [F.count("*").alias("n"), F.min("qualified_name").alias("c")]
    edges = g.edges.select("kind", "source", "target", "file_path", "line")
    ends = edges.select(F.col("source").alias("end"), F.lit(1).alias("source"), F.lit(0).alias("target")).unionByName(
        edges.select(F.col("target").alias("end"), F.lit(0).alias("source"), F.lit(1).alias("target"))
    ).groupBy("end").agg(F.max("source").alias("source"), F.max("target").alias("target"))
    by_key = index.groupBy(F.col("key").alias("end")).agg(*pick)
    loose = ends.join(shuffled(g.nodes.select(F.col("qualified_name").alias("end"))), "end", "left_anti")
    of = lambda end, more=True: F.count_if((F.col(end) == 1) & more)
    many = F.coalesce(F.col("n") > 1, F.lit(False))
    loose, seen = _counted(
        loose.join(shuffled(by_key), "end", "left"), "loose_ends",
        source=of("source"), target=of("target"), source_many=of("source", many), target_many=of("target", many),
    )
    src_file = file_of(F.col("source"))
    src_dir = F.when(src_file.contains("/"), F.regexp_replace(src_file, "/[^/]*$", "")).otherwise(F.lit(""))

    def scoped(end: str) -> tuple[DataFrame, int]:
        """(end, _file, near): the only candidate of an ambiguous end in the source's file, else below its directory."""
        names = _sized(loose.where((F.col(end) == 1) & many).select("end"), seen[f"{end}_many"])
        asked = edges.select(F.col(end).alias("end"), src_file.alias("_file"), src_dir.alias("_dir")).join(names, "end", "left_semi").distinct()
        near = index.withColumnRenamed("key", "end").join(names, "end", "left_semi")
        parts = F.split("file_path", "/")
        dirs = F.transform(
            F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
        )
        by_file = near.groupBy("end", F.col("file_path").alias("_file")).agg(*pick).where("n = 1").select("end", "_file", F.col("c").alias("cf"))
        by_dir = near.select("end", "qualified_name", F.explode(dirs).alias("_dir")).groupBy("end", "_dir").agg(*pick)
        by_dir = by_dir.where("n = 1").select("end", "_dir", F.col("c").alias("cd"))
        found = asked.join(shuffled(by_file), ["end", "_file"], "left").join(shuffled(by_dir), ["end", "_dir"], "left")
        rows, count = _counted(
            found.select("end", "_file", F.coalesce("cf", "cd").alias("near")).where(F.col("near").isNotNull()), "near_ends", held=F.count(F.lit(1)))
        return rows, count["held"]

    def side(rows: DataFrame, end: str) -> DataFrame:
        if not seen[end]:
            return rows.withColumn(f"{end}_node", F.col(end))
        found = loose.where(F.col(end) == 1).select(F.col("end").alias(end), "c", F.lit(True).alias("_loose"))
        rows = rows.join(_sized(found, seen[end]), end, "left")
        chosen = F.col("c")
        if seen[f"{end}_many"]:
            near, count = scoped(end)
            rows = rows.withColumn("_file", src_file).join(_sized(near.withColumnRenamed("end", end), count), [end, "_file"], "left")
            chosen = F.coalesce("near", "c")
        return rows.withColumn(f"{end}_node", F.when(F.col("_loose"), chosen).otherwise(F.col(end))).drop("c", "_loose", "_file", "near")

    both = side(side(edges, "target"), "source")
    return both.where(F.col("source_node").isNotNull() & F.col("target_node").isNotNull())
