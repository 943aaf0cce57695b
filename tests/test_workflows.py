"""Graphs, workflows, runs side by side with logs and a report, and the stream of frames."""

import logging
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.patchset import PatchSet
from geoloom.plans.executor import Executor, confusion, durations, grouped_errors, run_counts
from geoloom.plans.workflow import CyclicDependencyError, Graph, Input, Node, Output, Results, Workflow, chain, tables_of

EDGES = st.lists(st.tuples(st.integers(0, 10), st.integers(0, 10)).filter(lambda e: e[0] != e[1]), min_size=1, max_size=110)


@settings(max_examples=200, deadline=None)
@given(EDGES)
def test_order_of_acyclic_graphs(edges):
    edges = [(min(e), max(e)) for e in edges]
    g = Graph(edges)
    order = g.ordered()
    place = {v: k for k, v in enumerate(order)}
    assert sorted(place) == sorted({v for e in edges for v in e}) and all(place[a] < place[b] for a, b in edges)


@settings(max_examples=200, deadline=None)
@given(EDGES)
def test_cycles_are_found(edges):
    def reaches(a, b, seen=()):
        return any(y == b or (y not in seen and reaches(y, b, (*seen, y))) for x, y in edges if x == a)

    if any(reaches(v, v) for e in edges for v in e):
        with pytest.raises(CyclicDependencyError):
            Graph(edges).ordered()
    else:
        Graph(edges).ordered()


def test_changes_of_a_graph():
    g = Graph([(1, 2), (1, 2), (2, 3)], [9])
    assert g.indegrees() == {1: 0, 2: 2, 3: 1, 9: 0} and g.outdegree(1) == 2
    g.del_edge(1, 2)
    assert g.indegrees()[2] == 1
    g.del_vertex(2)
    assert g.after == {1: [], 3: [], 9: []}
    for f, a in ((g.del_edge, (1, 2)), (g.del_vertex, (2,))):
        with pytest.raises(ValueError):
            f(*a)
    g.add_vertex(4)
    g.add_edge(4, 5)
    assert g.ordered().index(4) < g.ordered().index(5)


def test_nodes_and_workflows():
    source = Node(Input(5), name="in")
    double, plus = Node(lambda v, by=2: v * by, [source], "f"), Node(lambda v: v + 1, [source], "f")
    total = Node(lambda a, b: a + b, [double, plus], "sum")
    ends = [Node(Output("all"), [total]), Node(Output("half"), [plus])]
    flow = Workflow.from_ends(*ends)
    assert sorted(flow.names.values()) == ["Output", "Output_2", "f", "f_2", "in", "sum"] and len(total.ancestors()) == 4
    run = flow.execute()
    assert run.outputs == {"all": 16, "half": 6} and not run.failed and set(run.stats) == set(flow.names.values()) and run.start <= run.end
    assert flow.execute({source: {"value": 1}, double: {"by": 10}}).outputs == {"all": 12, "half": 2}
    assert flow.execute({source: (3,)}).outputs["half"] == 4 and run.without_outputs().outputs == {} and run.outputs
    dot = flow.dot()
    assert dot.count("->") == 6 and "[shape=box" in dot and '"in" -> "f"' in dot
    nodes = chain((lambda: 1, "one"), (lambda v: v + 1, "two"), Output("x"))
    assert Workflow(nodes).execute().outputs == {"x": 2} and nodes[1].inputs == [nodes[0]]


def test_mistakes_in_workflows():
    a = Node(Input(1), name="a")
    b = Node(lambda v: v, [a], "b")
    for nodes in ([a, a], [b], [a, Node(Output("o"), [a]), Node(Output("o"), [a])]):
        with pytest.raises(ValueError):
            Workflow(nodes)
    for args in ((3,), (lambda: 1, ["no node"])):
        with pytest.raises(ValueError):
            Node(*args)
    with pytest.raises(ValueError):
        Workflow([a]).execute({b: {}})


def fails(v):
    raise KeyError("broken")


def test_a_failed_node_stops_its_run_only():
    a = Node(Input(1), name="a")
    bad = Node(fails, [a])
    flow = Workflow.from_ends(Node(Output("o"), [bad]))
    with pytest.raises(KeyError):
        flow.execute()
    run = flow.execute(raise_errors=False)
    assert run.failed and run.failed_node == "fails" and run.outputs == {} and run.stats["fails"].origin == "KeyError" and "broken" in run.stats["fails"].error and "Output" not in run.stats


def test_tables_stay_lazy_unless_asked(spark):
    a = Node(Input(), name="a")
    late = Node(lambda df: df.selectExpr("raise_error(string(id)) AS v"), [a], "late")
    flow = Workflow.from_ends(Node(Output("o"), [late]), Node(Output("p"), [late]))
    lazy = flow.execute({a: {"value": spark.range(3)}}, cache_shared=True)
    assert not lazy.failed and lazy.outputs["o"].is_cached
    lazy.outputs["o"].unpersist()
    strict = Workflow.from_ends(Node(Output("o"), [Node(lambda df: df.selectExpr("id", "raise_error(string(id)) AS v").where("v is null"), [a], "now")]))
    assert strict.execute({a: {"value": spark.range(3)}}, raise_errors=False, eager=True).failed_node == "now"
    assert tables_of(3) == [] and tables_of(PatchSet()) == [] and len(tables_of(spark.range(1))) == 1


def test_runs_logs_and_report(spark, tmp_path):
    log = logging.getLogger("work")

    def work(v):
        log.warning("value %s", v)
        if v == 2:
            raise ValueError("two is too much")
        return v

    a = Node(Input(), name="a")
    flow = Workflow.from_ends(Node(Output("o"), [Node(work, [a])]))
    seen = []
    runs = Executor(flow, [{a: {"value": k}} for k in (1, 2, 3, 4)], ["one", "two", "three <3>", "four"], logs=str(tmp_path / "logs"), action=lambda r: seen.append(r.outputs["o"]) if r.outputs["o"] != 4 else fails(4))
    out = runs.run(workers=3)
    assert runs.succeeded() == [0, 2] and runs.failed() == [1, 3] and sorted(seen) == [1, 3] and [r.failed_node for r in out] == [None, "work", None, "action"] and all(isinstance(r, Results) and not r.outputs for r in out)
    logs = runs.read_logs()
    assert all(f"value {k}" in text and not any(f"value {j}" in text for j in (1, 2, 3, 4) if j != k) for k, text in zip((1, 2, 3, 4), logs, strict=True)) and "broken" in logs[3]
    stats = runs.stats(spark)
    errors = grouped_errors(stats).collect()
    assert [(r.node, r.origin, r.runs) for r in errors] == [("work", "ValueError", ["two"])]
    per = {r.node: r for r in durations(stats).collect()}
    assert per["work"].n == 4 and per["Output"].n == 3 and per["work"].least <= per["work"].mean <= per["work"].most
    text = Path(runs.report(spark, str(tmp_path / "report.html"))).read_text()
    assert "2 of 4 runs" in text and "three &lt;3&gt;: finished" in text and "two: failed at work" in text and "digraph" in text and "ValueError" in text
    quiet = logging.Filter("nothing.else")
    filtered = Executor(flow, [{a: {"value": 1}}], logs=str(tmp_path / "more"), log_filter=quiet)
    filtered.run()
    assert filtered.read_logs() == [""] and filtered.names == ["1"] and Executor(flow, [{}]).read_logs() == [None]
    for names in (["x"], ["x", "x"]):
        with pytest.raises(ValueError):
            Executor(flow, [{}, {}], names)


def test_counts_and_confusion(spark):
    runs = spark.createDataFrame([(True,), (False,), (False,)], "failed boolean")
    assert run_counts(runs).first().asDict() == {"finished": 2, "failed": 1}
    pairs = spark.createDataFrame([(0, 0), (0, 1), (0, 1), (1, 1)], "t int, p int")
    assert {(r.t, r.p): round(r.value, 3) for r in confusion(pairs, "t", "p").collect()} == {(0, 0): 0.333, (0, 1): 0.667, (1, 1): 1.0}
    assert {(r.t, r.p): r.value for r in confusion(pairs, "t", "p", normalize=False).collect()} == {(0, 0): 1, (0, 1): 2, (1, 1): 1}
