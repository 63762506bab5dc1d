"""Scores, rejections, matching and groups on hand-made observations."""

import itertools
import random
from datetime import date
from decimal import Decimal

import pytest

from sheaf.operators import linkage
from sheaf.operators.matching import solve

SCHEMA = (
    "batch_id string, page_id string, document_type string, amount decimal(18,2), issue_date date, service_start date, service_end date, "
    "order_number string, vendor string, traveler string, route string, confidence double"
)
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


def page(batch, name, kind, **given):
    return [{"batch_id": batch, "page_id": name, "document_type": kind, "confidence": 0.9} | given]


STRONG = {"amount": Decimal("198.20"), "service_start": date(2024, 1, 1), "service_end": date(2024, 1, 3)}
PAGES = (
    page("strong", "p", "lodging_invoice", vendor="Ｈotel-Straße", **STRONG)
    + page("strong", "s", "lodging_statement", vendor="HOTEL STRASSE", **STRONG)
    + page("order", "p", "taxi_invoice", order_number=" A1 ")
    + page("order", "s", "taxi_itinerary", order_number="A1\u3000")
    + page("conflict", "p", "lodging_invoice", amount=Decimal(1), issue_date=date(2024, 1, 1), traveler="a")
    + page("conflict", "s", "lodging_statement", amount=Decimal(2), issue_date=date(2024, 1, 2), traveler="b")
    + page("types", "p", "lodging_invoice")
    + page("types", "s", "taxi_itinerary")
    + page("rivals", "p", "lodging_invoice", order_number="x")
    + page("rivals", "s1", "lodging_statement", order_number="x")
    + page("rivals", "s2", "lodging_statement", order_number="x")
    + page("dim", "p", "lodging_invoice", order_number="x", confidence=0.2)
    + page("dim", "s", "lodging_statement", order_number="x")
    + page("apart", "p", "lodging_invoice", issue_date=date(2024, 1, 1), amount=Decimal(5), vendor="v")
    + page("apart", "s", "lodging_statement", service_start=date(2024, 1, 1), amount=Decimal("5.00"), vendor="V")
)


@pytest.fixture(scope="module")
def outcome(spark):
    from sheaf.durable import settled

    pages = spark.createDataFrame([tuple(p.get(f) for f in FIELDS) for p in PAGES], SCHEMA)
    pairs = settled(linkage.candidates(pages))
    rejected = settled(linkage.rejections(pairs))
    matched = settled(linkage.matches(pairs, rejected))
    groups = linkage.print_order(linkage.groups(pages, matched)).collect()
    lone = {(r.batch_id, r.support_id): r.code for r in linkage.unmatched(pages, pairs, rejected, matched).collect()}
    return {(r.batch_id, r.support_id): r for r in pairs.collect()}, {(r.batch_id, r.support_id) for r in matched.collect()}, groups, lone


def test_scores(outcome):
    pairs, *_ = outcome
    assert pairs["strong", "s"].score == Decimal("0.8500")
    assert pairs["strong", "s"].evidence == ["amount_exact", "vendor", "date_overlap"]
    assert (pairs["order", "s"].score, pairs["order", "s"].evidence) == (Decimal("0.75"), ["order_exact"])
    assert pairs["conflict", "s"].conflicts == ["amount_conflict", "date_conflict", "traveler_conflict"]
    assert pairs["conflict", "s"].score == 0
    assert pairs["apart", "s"].score == Decimal("0.7")
    assert pairs["dim", "s"].confidence_limited and pairs["dim", "s"].score == 0


def test_matches_and_reasons(outcome):
    _, matched, groups, lone = outcome
    assert matched == {("strong", "s"), ("order", "s"), ("apart", "s")}
    assert lone == {
        ("conflict", "s"): "low_confidence_association",
        ("types", "s"): "unmatched_support",
        ("rivals", "s1"): "ambiguous_association",
        ("rivals", "s2"): "ambiguous_association",
        ("dim", "s"): "low_observation_confidence",
    }
    placed = sorted((g.batch_id, m) for g in groups for m in g.members)
    assert placed == sorted((p["batch_id"], p["page_id"]) for p in PAGES)
    assert [g.rank for g in groups] == sorted(g.rank for g in groups)
    assert all(g.id.startswith("group-") and len(g.id) == 22 for g in groups)


def test_solver_is_optimal():
    draw = random.Random(5)
    for _ in range(400):
        edges = [
            (f"s{i}", f"p{j}", draw.choice([6500, 7000, 7500, 9000, 10000]))
            for i in range(draw.randrange(1, 6))
            for j in range(draw.randrange(1, 6))
            if draw.random() < 0.6
        ]
        weight = {(s, p): w for s, p, w in edges}
        options = [[None, *[p for p in {e[1] for e in edges} if (s, p) in weight]] for s in sorted({e[0] for e in edges})]
        names = sorted({e[0] for e in edges})
        best = max(
            sum(weight[s, p] for s, p in zip(names, c, strict=True) if p)
            for c in itertools.product(*options)
            if len([p for p in c if p]) == len({p for p in c if p})
        )
        found = solve(edges)
        assert len(set(found.values())) == len(found) and sum(weight[i] for i in found.items()) == best
