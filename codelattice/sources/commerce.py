"""The driver's commerce tables viewed as a code graph, findings and rules.

A part is a symbol, a (type, part block) pair is a file, and a returned line
item is a reference from the part that stands for its order to its own part.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions.paths import qualified_name
from codelattice.model import CodeGraph
from codelattice.operators import communities, leiden, risk
from codelattice.operators import findings as findings_op
from codelattice.operators import flows as flows_op
from codelattice.operators.search import node_documents
from codelattice.session import shuffled, stage, stage_root
from codelattice.sinks.search_index import SearchIndex

# Part names hold no security words, so scores over them look for these.
CHECK_WORDS = ("ring", "bolt")

# Every line item is a reference. Quantity of a returned line → what it means;
# smaller returned lines and all others spread over the remaining kinds, so calls stay sparse.
RESOLVED_CALL, EXTERNAL_CALL, BARE_CALL = 48, 47, 46
FILE_IMPORT, INHERIT, SYMBOL_IMPORT, DEPEND = 45, 44, 43, 42
# Relations that make up the structure of a program; communities are sought over these.
STRUCTURE = ("CALLS", "CONTAINS", "INHERITS", "TESTED_BY")
OTHER_KINDS = ("DEPENDS_ON", "REFERENCES", "IMPLEMENTS", "IMPORTS_FROM")
KINDS = ("CALLS", "INHERITS", *OTHER_KINDS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    base = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), key.cast("string"))
    kind = (
        F.when(size % 10 == 0, "Class").when(size % 10 == 1, "Test").otherwise("Function")
    )
    name = (
        F.when(size % 10 == 0, F.concat(F.regexp_replace(F.initcap("p_name"), " ", ""), key.cast("string")))
        .when(size % 10 == 1, F.concat(F.lit("test_"), base))
        .when(size % 20 == 2, F.concat(F.lit("handle_"), base))
        .otherwise(base)
    )
    brand = F.regexp_replace("p_brand", "#", "")
    start = (key % 40 * 60 + 1).cast("int")
    shaped = table(spark, sf_dir, "part").select(
        key.alias("part_key"),
        kind.alias("kind"),
        name.alias("name"),
        F.concat(
            F.lit("src/"), F.lower("p_type"), F.lit("/m"),
            F.floor(key / 40).cast("string"), F.lit(".py"),
        ).alias("file_path"),
        start.alias("line_start"),
        F.when(size != 49, (start + size).cast("int")).alias("line_end"),
        F.when(size % 4 == 0, "python").when(size % 4 == 1, "javascript").when(size % 4 == 2, "go")
        .otherwise("").alias("language"),
        F.when((size % 10).isin(3, 4), brand).alias("parent_name"),
        F.when(kind != "Class", F.concat(F.lit("("), F.lower(brand), F.lit(", "), size.cast("string"), F.lit(")")))
        .alias("params"),
        F.when((kind != "Class") & (F.col("p_retailprice") > 1000), "float").alias("return_type"),
        (kind == "Test").alias("is_test"),
        F.when(size % 20 == 5, F.array(F.lit("app.route"))).alias("decorators"),
        F.create_map(F.lit("brand"), F.col("p_brand")).alias("extra"),
    )
    return shaped.withColumn(
        "qualified_name",
        qualified_name(F.col("kind"), F.col("file_path"), F.col("parent_name"), F.col("name")),
    )


def file_nodes(symbols: DataFrame) -> DataFrame:
    text = F.lit(None).cast("string")
    return symbols.groupBy("file_path").agg(F.max("line_start").alias("last")).select(
        F.lit("File").alias("kind"),
        F.col("file_path").alias("name"),
        F.col("file_path").alias("qualified_name"),
        "file_path",
        F.lit(1).alias("line_start"),
        (F.col("last") + 59).cast("int").alias("line_end"),
        F.lit("python").alias("language"),
        text.alias("parent_name"),
        text.alias("params"),
        text.alias("return_type"),
        F.lit(False).alias("is_test"),
        F.lit(None).cast("array<string>").alias("decorators"),
        F.lit(None).cast("map<string,string>").alias("extra"),
    )


def _numbered(ends: DataFrame, name: str, *columns: str) -> DataFrame:
    """Distinct rows of the columns, each with a number ``id``; stored, so that the numbers stay."""
    return stage(ends.select(*columns).distinct().withColumn("id", F.monotonically_increasing_id()), name)


def references(spark: SparkSession, sf_dir: str, symbols: DataFrame) -> DataFrame:
    """Edges from line items.

    Ends are numbers until equal edges are one row: far fewer bytes than names in every shuffle. Names come back in the last two joins.
    """
    parts = table(spark, sf_dir, "part").agg(F.max("p_partkey") + 1).scalar()
    symbols = stage(symbols.select("part_key", "qualified_name", "name", "file_path", "line_start", "is_test"), "symbols")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    # What an edge may start from, and what it may lead to; an edge without a name at either end is none.
    source = lambda name: symbols.select(F.col(name).alias("source"), "file_path").where(F.col("source").isNotNull())
    from_ends = _numbered(source("qualified_name").unionByName(source("file_path")), "sources", "source", "file_path")
    target = lambda rows, name: rows.select(F.col(name).alias("target")).where(F.col("target").isNotNull())
    to_ends = _numbered(
        target(symbols, "qualified_name").unionByName(target(symbols, "name")).unionByName(target(symbols, "file_path"))
        .unionByName(target(suppliers, "s_name")), "targets", "target")
    of_file = from_ends.where(F.col("source") == F.col("file_path"))
    src = (
        symbols.join(shuffled(from_ends.select(F.col("source").alias("qualified_name"), "file_path", F.col("id").alias("own"))), ["qualified_name", "file_path"], "left")
        .join(shuffled(of_file.select("file_path", F.col("id").alias("whole"))), "file_path", "left")
        .select(F.col("part_key").alias("src_key"), "own", "whole", F.col("line_start").alias("src_line"), F.col("is_test").alias("src_test")).distinct()
    )
    to = lambda rows, name, number: rows.join(shuffled(to_ends.select(F.col("target").alias(name), F.col("id").alias(number))), name, "left")
    dst = to(to(to(symbols, "qualified_name", "to_symbol"), "name", "to_name"), "file_path", "to_file").select(
        F.col("part_key").alias("dst_key"), "to_symbol", "to_name", "to_file").distinct()
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % parts).alias("src_key"), F.col("l_partkey").alias("dst_key"),
        "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"),
        F.coalesce((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= DEPEND), F.lit(False)).alias("coded"),
    )
    # Kinds are places in KINDS; counted from its end below zero, as an array is. Without a quantity it is the last one.
    q, coded, of = F.col("q"), F.col("coded"), lambda kind: F.lit(KINDS.index(kind) + 1)
    other, first = q % len(OTHER_KINDS), KINDS.index(OTHER_KINDS[0]) + 1
    plain = F.coalesce(F.when(other < 0, other + len(KINDS) + 2).otherwise(other + first), of(OTHER_KINDS[-1]))
    coded_kind = (
        F.when(q.isin(FILE_IMPORT, SYMBOL_IMPORT), of("IMPORTS_FROM")).when(q == INHERIT, of("INHERITS"))
        .when(q == DEPEND, of("DEPENDS_ON")).otherwise(of("CALLS"))
    )
    begun = lambda rows: rows.join(shuffled(src), "src_key").withColumn("kind", F.when(coded, coded_kind).otherwise(plain).cast("tinyint")).select(
        "dst_key", "kind", F.when(F.col("kind") == of("IMPORTS_FROM"), F.col("whole")).otherwise(F.col("own")).alias("src"),
        (F.col("src_line") + F.col("l_linenumber")).cast("int").alias("line"),
        F.coalesce(coded & (q >= RESOLVED_CALL) & F.col("src_test"), F.lit(False)).alias("tests"),
        F.when(coded, q).alias("code"), "l_suppkey",
    ).where(F.col("src").isNotNull())
    ends, code, external = ["kind", "src", "dst", "line", "tests"], F.col("code"), coded & (q == EXTERNAL_CALL)
    named = code.isin(BARE_CALL, INHERIT) | (F.col("kind") == of("IMPLEMENTS"))
    inside = begun(lines.where(~external)).drop("l_suppkey").join(shuffled(dst), "dst_key").withColumn(
        "dst", F.when(named, F.col("to_name")).when(code == FILE_IMPORT, F.col("to_file")).otherwise(F.col("to_symbol"))).select(*ends)
    # A call to a supplier needs its part to exist, as every edge does.
    named_to = to(suppliers, "s_name", "dst").select(F.col("s_suppkey").alias("l_suppkey"), "dst").distinct()
    outside = begun(lines.where(external)).join(shuffled(dst.select("dst_key")), "dst_key", "left_semi").join(named_to, "l_suppkey").select(*ends)
    edges = stage(
        inside.unionByName(outside).where(F.col("dst").isNotNull())
        .groupBy("kind", "src", "dst", "line").agg(F.max("tests").alias("tests")), "numbered_edges")
    refs = (
        edges.join(shuffled(to_ends.withColumnRenamed("id", "dst")), "dst").drop("dst")
        .join(shuffled(from_ends.withColumnRenamed("id", "src")), "src").drop("src").where(F.col("source") != F.col("target"))
    )
    # A resolved call out of a test also yields TESTED_BY, production → test.
    copies = F.when(F.col("tests"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return refs.select("*", F.explode(copies).alias("_tested")).select(
        F.when(F.col("_tested"), "TESTED_BY").otherwise(F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind").cast("int"))).alias("kind"),
        F.when(F.col("_tested"), F.col("target")).otherwise(F.col("source")).alias("source"),
        F.when(F.col("_tested"), F.col("source")).otherwise(F.col("target")).alias("target"),
        "file_path", "line",
    )


def build_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    symbols = symbol_nodes(spark, sf_dir)
    nodes = symbols.drop("part_key").unionByName(file_nodes(symbols))
    contains = symbols.select(
        F.lit("CONTAINS").alias("kind"), F.col("file_path").alias("source"),
        F.col("qualified_name").alias("target"), "file_path", F.col("line_start").alias("line"),
    )
    return CodeGraph(nodes, references(spark, sf_dir, symbols).unionByName(contains))


def raw_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scanner findings, one scan run per day."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("seq"),
        F.concat(F.lit("rule."), F.col("event_type"), F.lit("."), (e % 5).cast("string")).alias("rule_id"),
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("file_path"),
        k.alias("line_start"),
        (k + F.floor(F.col("value")).cast("int") % 4).cast("int").alias("line_end"),
        F.when(e % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("CWE-0"), (e % 7).cast("string"))).alias("cwe"),
        F.when(e % 6 == 0, "CRITICAL").when(e % 6 == 1, "HIGH").when(e % 6 == 2, "ERROR")
        .when(e % 6 == 3, "WARNING").when(e % 6 == 4, "INFO").alias("severity"),
        F.to_date("ts").alias("run_day"),
        "value",
    )


class Workspace:
    """One stored graph with its derived tables, built once and then read.

    The tables live in the shared folder, as a stored graph would.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def graph(self) -> CodeGraph:
        built = build_graph(self.spark, self.sf_dir)
        return CodeGraph(stage(built.nodes, "nodes"), stage(built.edges, "edges", ("kind",)))

    @cached_property
    def findings(self) -> DataFrame:
        return raw_findings(self.spark, self.sf_dir)

    @cached_property
    def changed_files(self) -> DataFrame:
        """Files whose symbols shipped on the latest day: the change set."""
        lines = self.table("lineitem").select("l_partkey", "l_shipdate")
        latest = self.table("lineitem").agg(F.max("l_shipdate")).scalar()
        keys = lines.where(F.col("l_shipdate") == latest).select(F.col("l_partkey").alias("part_key"))
        return (
            symbol_nodes(self.spark, self.sf_dir).join(keys, "part_key", "left_semi")
            .select("file_path").distinct()
        )

    @cached_property
    def changed_ranges(self) -> DataFrame:
        """Changed line ranges: one per line item of a part."""
        lines = (
            self.table("lineitem")
            .select(F.col("l_partkey").alias("part_key"), "l_linenumber", "l_quantity")
        )
        placed = symbol_nodes(self.spark, self.sf_dir).select("part_key", "file_path", "line_start")
        return (
            lines.join(shuffled(placed), "part_key")
            .select(
                "file_path",
                (F.col("line_start") + F.col("l_linenumber") * 7).cast("int").alias("start"),
                (F.col("line_start") + F.col("l_linenumber") * 7 + F.col("l_quantity") % 20).cast("int").alias("end"),
            )
            .distinct()
        )

    @cached_property
    def overlapping(self) -> DataFrame:
        """Nodes that meet a changed range, stored once."""
        return stage(risk.overlapping_nodes(self.graph, self.changed_ranges), "overlapping")

    @cached_property
    def graph_before_change(self) -> CodeGraph:
        """The graph as it was: in changed files some symbols and calls did not exist yet, some calls were there that are gone."""
        changed = self.changed_files.withColumn("changed", F.lit(True))
        nodes = self.graph.nodes.join(changed, "file_path", "left").where(
            F.col("changed").isNull() | (F.col("kind") == "File") | (F.col("line_start") % 4 != 1))
        edges = self.graph.edges.join(changed, "file_path", "left")
        call = F.col("kind") == "CALLS"
        old = edges.where(F.col("changed").isNull() | ~call | (F.col("line") % 2 == 0)).withColumn(
            "kind", F.when(F.col("changed") & (F.col("kind") == "REFERENCES") & (F.col("line") % 5 == 0), "CALLS")
            .otherwise(F.col("kind")))
        return CodeGraph(nodes.select(self.graph.nodes.columns), old.select(self.graph.edges.columns))

    # Derived tables, stored once like the graph itself.

    @cached_property
    def flow_members(self) -> DataFrame:
        return stage(flows_op.with_positions(flows_op.trace_flows(self.graph)), "flow_members")

    @cached_property
    def flows(self) -> DataFrame:
        return stage(flows_op.score_flows(self.graph, self.flow_members, CHECK_WORDS), "flows")

    @cached_property
    def file_members(self) -> DataFrame:
        return communities.file_members(self.graph)

    @cached_property
    def label_members(self) -> DataFrame:
        return stage(communities.propagated_members(self.graph, split_above=None), "label_members")

    @cached_property
    def leiden_members(self) -> DataFrame:
        return stage(leiden.leiden_members(self.graph, kinds=STRUCTURE), "leiden_members")

    # Search indexes, stored once; every search reads the cells of its terms.

    @cached_property
    def document_index(self) -> SearchIndex:
        return self._index(self.document_texts)

    @cached_property
    def stemmed_index(self) -> SearchIndex:
        return self._index(self.document_texts, stem=True)

    @cached_property
    def node_index(self) -> SearchIndex:
        """The four texts of every node; a top folder is a repository."""
        texts = node_documents(self.graph).withColumnRenamed("doc_id", "qualified_name")
        return self._index(self.repo_nodes.join(texts, "qualified_name").select("repo", "file_path", F.col("qualified_name").alias("doc_id"), "text"))

    @property
    def document_texts(self) -> DataFrame:
        """Documents as (repo, file_path, doc_id, text); a source is a repository and each document a file."""
        path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return self.table("documents").select(F.col("source").alias("repo"), path.alias("file_path"), "doc_id", "text")

    @property
    def repo_nodes(self) -> DataFrame:
        return self.graph.nodes.withColumn("repo", F.split("file_path", "/")[1])

    def _index(self, docs: DataFrame, stem: bool = False) -> SearchIndex:
        return SearchIndex.build(self.spark, f"{stage_root(self.spark)}/{uuid.uuid4().hex}/index", docs, stem)

    @cached_property
    def history(self) -> DataFrame:
        return findings_op.fold_history(self.normalised, run="run_day")

    @cached_property
    def normalised(self) -> DataFrame:
        return findings_op.normalise(self.findings).withColumn(
            "snippet", F.floor("value").cast("bigint").cast("string")
        )

    @cached_property
    def rule_classes(self) -> DataFrame:
        """One rule class per noun of the part names."""
        noun = F.split("p_name", " ")[1]
        return self.table("part").select(noun.alias("id")).distinct().select(
            "id", F.initcap("id").alias("name"),
            F.concat(F.lit("CWE-"), (F.length("id") * 10).cast("string")).alias("cwe_id"),
            F.when(F.length("id") == 3, "CRITICAL").when(F.length("id") == 4, "HIGH")
            .when(F.length("id") == 5, "MEDIUM").otherwise("LOW").alias("severity"),
        )

    @cached_property
    def signatures(self) -> DataFrame:
        """One taint signature per part name; its adjective decides the role."""
        first = F.length(F.split("p_name", " ")[0])
        return self.table("part").groupBy("p_name").agg(F.min("p_partkey").alias("seq")).select(
            F.concat(F.lit("sig-"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("id"),
            F.replace("p_name", F.lit(" "), F.lit("_")).alias("qualified_pattern"),
            F.split("p_name", " ")[1].alias("vuln_class_id"),
            F.when(first % 3 == 0, "SINK").when(first % 3 == 1, "SOURCE").otherwise("SANITIZER").alias("sig_type"),
            F.when(first % 2 == 0, "any").otherwise("python").alias("language"),
            "seq",
        )


_OPEN: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, sf_dir)
    return _OPEN[key]
