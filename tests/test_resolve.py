"""Export resolution against its rules on lists."""

from codelattice.model import CodeGraph
from codelattice.operators import resolve


def _export_by_hand(nodes, edges):
    """The rules of export resolution on lists: exact, only candidate, only one of the file, only one below the directory, first."""
    keys = {}
    for n in nodes:
        path, module = n["file_path"], n["file_path"].replace("/", ".").replace(".py", "")
        if n["kind"] == "File":
            parts = path.split("/")
            names = {n["name"], module, *["/".join(parts[i:]) for i in range(len(parts))]}
        else:
            names = {n["name"], n["qualified_name"].split("::")[-1], f"{module}.{n['name']}"}
        for key in names - {""}:
            keys.setdefault(key, set()).add((n["qualified_name"], path))
    known = {n["qualified_name"] for n in nodes}

    def node(end, source):
        if end in known:
            return end
        found, file = keys.get(end, set()), source.split("::")[0]
        folder = file.rsplit("/", 1)[0] if "/" in file else ""
        near = [q for q, p in found if p == file]
        below = [q for q, p in found if folder == "" or p.startswith(folder + "/")]
        for few in (found and [q for q, _ in found], near, below):
            if len(few) == 1:
                return few[0]
        return min((q for q, _ in found), default=None)

    pairs = [(e["kind"], node(e["source"], e["source"]), node(e["target"], e["source"])) for e in edges]
    return sorted(p for p in pairs if None not in p)


def test_export_meets_only_loose_ends(spark, monkeypatch):
    """Ambiguous, scoped and unknown ends as by hand; an edge is shuffled only for a side that has loose ends."""
    files = [f"{d}/{f}.py" for d in ("a", "a/b", "c") for f in ("x", "y")]
    nodes = [dict(kind="File", name=f, qualified_name=f, file_path=f) for f in files]
    nodes += [dict(kind="Function", name=n, qualified_name=f"{f}::{n}", file_path=f) for i, f in enumerate(files) for n in ("run", f"only{i}", "go" if i % 4 == 0 else f"other{i}")]
    ends = [n["qualified_name"] for n in nodes] + ["run", "go", "only1", "x.py", "b/y.py", "a.b.x.run", "missing", "c.y"]
    some = [dict(kind="CALLS", source=s, target=t, file_path=s.split("::")[0], line=i) for i, (s, t) in enumerate((s, t) for s in ends for t in ends)]
    frame = lambda rows: spark.createDataFrame(rows, ", ".join(f"{k} {'int' if k == 'line' else 'string'}" for k in rows[0]))
    graph = lambda edges: CodeGraph(frame(nodes), frame(edges))
    answer = lambda df: sorted((r["kind"], r["source_node"], r["target_node"]) for r in df.collect())
    assert answer(resolve.resolve_for_export(graph(some))) == _export_by_hand(nodes, some)
    monkeypatch.setattr(resolve, "FEW_ROWS", 0)
    assert answer(resolve.resolve_for_export(graph(some))) == _export_by_hand(nodes, some)
    exact = [e for e in some if "::" in e["source"] and e["target"] in ("only1", "missing", files[0])]
    df = resolve.resolve_for_export(graph(exact))
    assert answer(df) == _export_by_hand(nodes, exact)
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Join") == 1
