"""Argument shapes and values that reach sinks, on written functions."""

import pytest

from codelattice.operators import value_flow as V
from codelattice.sources.value_flow import extract_flows

APP = '''
import os

def concat():
    user_id = request.args.get("id")
    query = "SELECT " + user_id
    cursor.execute(query)

def filled():
    name = request.args.get("name")
    cursor.execute(f"SELECT {name}")

def percent():
    a, b = request.form.get("a"), 1
    cursor.execute("SELECT %s %s" % (a, b))

def safe():
    user_id = request.args.get("id")
    cursor.execute("SELECT ?", (user_id,))

def overwritten():
    q = request.args.get("id")
    q = "fixed"
    cursor.execute(q)

def maybe(flag):
    q = "fixed"
    if flag:
        q = request.args.get("id")
    cursor.execute(q)

def jumps(rows):
    q = "fixed"
    for r in rows:
        if r:
            q = request.args.get("id")
            break
        q = "other"
    cursor.execute(q)

def carried(rows):
    text = ""
    late = ""
    for r in rows:
        cursor.execute(late)
        late = text
        text = request.args.get("id")

def cleaned():
    cursor.execute("SELECT " + escape(request.args.get("id")))

def tries():
    try:
        q = request.args.get("id")
        q = risky(1)
    except ValueError:
        cursor.execute(q)

def over(x):
    return "SELECT " + x

class Box:
    def run(self, text, tail=None):
        self.db.execute(text)

def across():
    q = over(request.args.get("id"))
    box.run("a", tail=q)
    box.run(q)

def ends():
    q = request.args.get("id")
    return 1
    cursor.execute(q)

def several():
    a = "x"
    a = b = request.args.get(a)
    a, b = b, "y"
    c = d = a.strip()
    cursor.execute(d)
    cursor.execute(*[c])

def walrus():
    if (q := request.args.get("id")):
        q += "x"
        cursor.execute(q)
'''


@pytest.fixture(scope="module")
def flows(spark):
    files = [("app.py", APP), ("bad.py", "def f(:\n"), ("none.py", None), ("empty.py", "")]
    return extract_flows(spark.createDataFrame(files, "file_path string, text string")).persist()


def patterns(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "pattern string")


def test_shapes(flows):
    rows = {(r["func"].split("::")[1], r["position"]): r for r in V.call_arguments(flows).where("callee = 'cursor.execute'").collect()}
    shape = lambda f, p=0: (rows[f, p]["shape"], rows[f, p]["concatenated"], rows[f, p]["parameterised"])
    assert shape("concat") == ("identifier", False, False)
    assert shape("filled") == ("f_string", True, False)
    assert shape("percent") == ("percent_format", True, False)
    assert shape("safe") == ("string_literal", False, False) and shape("safe", 1) == ("tuple", False, True)
    assert shape("cleaned") == ("binary_op", True, False)


def test_values_that_reach_sinks(spark, flows):
    rows = V.argument_taint(
        flows, patterns(spark, "request."), patterns(spark, "execute"), patterns(spark, "escape")).collect()
    several = [r["hops"] for r in rows if r["func"].endswith("several")]
    assert several == [3, 3]
    rows = [r for r in rows if not r["func"].endswith("several")]
    got = {r["func"].split("::")[1]: (r["concatenated"], r["hops"]) for r in rows}
    assert got == {"concat": (True, 2), "filled": (True, 1), "percent": (True, 1), "maybe": (False, 1), "jumps": (False, 1),
                   "carried": (False, 2), "tries": (False, 1), "Box.run": (True, got["Box.run"][1]), "walrus": (True, 2)}
    assert len(rows) == len(got)


def test_without_rows_or_patterns(spark, flows):
    nothing = patterns(spark, "x").limit(0)
    assert V.argument_taint(flows, nothing, patterns(spark, "execute"), nothing).count() == 0
    assert V.argument_taint(flows.limit(0), patterns(spark, "request"), patterns(spark, "execute"), nothing).count() == 0
