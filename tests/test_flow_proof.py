"""Potentials prove a flow to be the cheapest, and the certificate finds flows that are not."""

from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.operators import flow

EDGES = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.integers(0, 9), st.integers(0, 6)), min_size=1, max_size=14)


@settings(max_examples=200, deadline=None)
@given(EDGES, st.integers(1, 9))
def test_no_edge_is_priced_wrongly(edges, demand):
    status, flows, potential = flow.priced_flow(edges, 0, 5, demand)
    for (u, v, cost, cap), f in zip(edges, flows):
        reduced = cost + potential[u] - potential[v]
        assert 0 <= f <= cap and not (f < cap and reduced < 0 and u != v) and not (f > 0 and reduced > 0)
    assert status in ("Optimal", "Infeasible")


EDGE = "graph long, u long, v long, cost long, cap long"


def test_certificates(spark):
    edges = spark.createDataFrame([(g, u, v, c, k) for g in (0, 1) for u, v, c, k in ((0, 1, 1, 5), (0, 2, 4, 9), (1, 3, 1, 5), (2, 3, 1, 9), (0, 3, 9, 2), (0, 3, 9, 2))], EDGE)
    wanted = spark.createDataFrame([(0, 0, 3, 8), (1, 0, 3, 30)], "graph long, source long, sink long, demand long")
    flows, potentials, status = flow.flow_and_potentials(edges, wanted)
    assert {r.graph: r.status for r in status.collect()} == {0: "Optimal", 1: "Infeasible"}
    proof = {r.graph: r for r in flow.certificate(flows, potentials, wanted).collect()}
    assert (proof[0].shipped, proof[0].cost, proof[1].shipped) == (8, 5 * 2 + 3 * 5, 18)
    assert all((r.unbalanced, r.over, r.price, r.gap) == (0, 0, 0, 0) for r in proof.values())

    dear = flows.withColumn("flow", flows.flow + ((flows.u == 0) & (flows.v == 3)).cast("long") - ((flows.u == 2) | (flows.v == 2)).cast("long"))
    assert all(r.price for r in flow.certificate(dear, potentials, wanted).where("graph = 0").collect())
    lost = flows.withColumn("flow", flows.flow + (flows.u == 1).cast("long"))
    bad = flow.certificate(lost, potentials, wanted).where("graph = 0").first()
    assert bad.unbalanced == 1 and bad.over == 1 and bad.gap != 0
