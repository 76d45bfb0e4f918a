import math
import random

import pytest

from costweave.operators import report
from costweave.operators.similar import SimilarityWeights, similar_projects, with_project_columns

PROJECT = "project_id long, country string, city string, length_km double, tunnel_pct double"
REQUEST = PROJECT.replace("project_id", "request_id")


def brute_force(requests, projects, n, w=SimilarityWeights()):
    result = {}
    for rid, country, city, length, tunnel in requests:
        if length is None or tunnel is None:
            continue
        scored = []
        for pid, c, t, other, share in projects:
            if other is None or share is None or other <= -0.5:
                continue
            same = country is not None and c == country
            place = same and city is not None and t == city
            score = (
                w.place * place + w.country * same
                + 1 / (1 + abs(math.log(other + 0.5) - math.log(length + 0.5)) * w.length_scale)
                + 1 / (1 + abs(share - tunnel) * w.tunnel_scale)
            )
            scored.append((-round(score, 9), pid))
        result[rid] = [(pid, -s) for s, pid in sorted(scored)[:n]]
    return result


def run(spark, requests, projects, **options):
    found = similar_projects(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(projects, PROJECT), **options)
    got = {}
    for r in found.orderBy("request_id", "rank").collect():
        got.setdefault(r["request_id"], []).append((r["project_id"], r["score"]))
    return got


def tables(seed, n_projects=600, n_requests=60):
    rnd = random.Random(seed)

    def place():
        # a third in one country, a few without country or city
        country = rnd.choice(["HOT", "HOT", "A", "B", "C", None])
        return country, rnd.choice([f"{country}-{rnd.randrange(5)}", None])

    projects = []
    for i in range(n_projects):
        country, city = place()
        length, tunnel = math.exp(rnd.gauss(2, 1.5)), rnd.random()
        if i % 3 == 0:  # a third of the table is one dense spot, half of it exact copies
            length, tunnel = (10.0, 0.5) if i % 2 else (10.0 + rnd.random() * 1e-3, 0.5 + rnd.random() * 1e-3)
        projects.append((i * 7 % n_projects, country, city, None if i % 50 == 7 else length, None if i % 60 == 3 else tunnel))
    requests = []
    for i in range(n_requests):
        country, city = place()
        requests.append((i, rnd.choice([country, "NOWHERE"]), city, math.exp(rnd.gauss(2, 1.5)), rnd.random()))
    requests += [(900 + i, "HOT", "HOT-1", 10.0, 0.5) for i in range(20)] + [(990, "A", "x", None, 0.5)]
    return requests, projects


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    requests, projects = tables(seed)
    got, expected = run(spark, requests, projects, n=5, fan_out=4), brute_force(requests, projects, 5)
    assert got.keys() == expected.keys()
    for rid, best in expected.items():
        assert [p for p, _ in got[rid]] == [p for p, _ in best]
        assert [s for _, s in got[rid]] == pytest.approx([s for _, s in best], abs=1e-8)


def test_other_weights_equal_brute_force(spark):
    requests, projects = tables(3, 300, 30)
    w = SimilarityWeights(place=0.1, country=0.05, length_scale=0.5, tunnel_scale=10.0)
    got, expected = run(spark, requests, projects, n=8, weights=w), brute_force(requests, projects, 8, w)
    assert {k: [p for p, _ in v] for k, v in got.items()} == {k: [p for p, _ in v] for k, v in expected.items()}


def test_fewer_projects_than_wanted_and_perfect_match(spark):
    projects = [(1, "A", "x", 10.0, 0.5), (2, "A", "y", 10.0, 0.5), (3, "B", "x", 20.0, 0.1)]
    found = similar_projects(
        spark.createDataFrame([(7, "A", "x", 10.0, 0.5)], REQUEST), spark.createDataFrame(projects, PROJECT)
    )
    rows = found.orderBy("rank").collect()
    assert [r["project_id"] for r in rows] == [1, 2, 3]
    assert rows[0]["score"] == 6.5 and rows[0]["match_percent"] == 100
    assert [r["same_place"] for r in rows] == [True, False, False]


def test_display_text(spark):
    projects = spark.createDataFrame(
        [(1, "TR", "Ankara", "L", 10.0, 0.5, 1234.4), (2, "XX", "y", "M", 12.25, 0.125, 99.5)],
        "project_id long, country string, city string, line string, length_km double, tunnel_pct double, cost_per_km_2023_musd double",
    )
    found = similar_projects(spark.createDataFrame([(7, "TR", "Ankara", 10.0, 0.5)], REQUEST), projects)
    full = with_project_columns(found, projects, projects.columns[1:])
    a, b = report.similar_text(full).orderBy("rank").collect()
    assert (a["match"], a["country_name"], a["tunnel_text"], a["cost_text"]) == ("100%", "Turkey", "50%", "$1,234 M")
    assert (b["country_name"], b["length_text"], b["tunnel_text"]) == ("XX", "12.2", "12%")
