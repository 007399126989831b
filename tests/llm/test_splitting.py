import random

import pytest
from conftest import rows

from siftlake.llm.splitting import split_documents, split_places

NATURAL = 0


def check(data: bytes, limit=4096, overlap=256):
    spans = split_places(data, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(data)
    for (_, e), (s, t) in zip(spans, spans[1:]):
        assert overlap - 3 <= e - s <= overlap and t > e
    for s, e in spans:
        assert e - s <= limit
        data[s:e].decode()
    return spans


def text(r, kind, n):
    out = []
    while sum(map(len, out)) < n:
        words = " ".join("w" * r.randrange(1, 12) for _ in range(r.randrange(3, 25)))
        out.append({"prose": words + ". ", "lines": words + "\n", "paragraphs": words + ".\n\n", "cjk": "これは文です。" * r.randrange(1, 9), "csv": "1,2;3" * 20}[kind])
        if r.random() < 0.02:
            out.append("```\ncode();\n\nmore();\n```\n" if r.random() < 0.5 else "\n## Head\n")
    return "".join(out).encode()


@pytest.mark.parametrize("kind", ["prose", "lines", "paragraphs", "cjk", "csv"])
def test_pieces_hold_all_rules(kind):
    r = random.Random(kind)
    for n in (4000, 4097, 9000, 60_000):
        check(text(r, kind, n))


def test_no_break_at_all():
    check(b"x" * 20_000)
    check("é".encode() * 10_000)
    check("😀".encode() * 5_000)
    check(b"a " + b"y" * 12_000 + b" b" * 3_000)


def test_never_inside_a_word_or_code_block_without_need():
    r = random.Random(8)
    data = text(r, "prose", 50_000)
    for _, e in check(data)[:-1]:
        assert data[e - 1 : e].isspace()
    blocks = b"\n".join(b"intro text here.\n\n```\n" + b"call(x);\n\n" * 120 + b"```\n" for _ in range(12))
    for _, e in check(blocks)[:-1]:
        assert blocks[:e].count(b"```") % 2 == 0


def brute(places, costs, n, limit, overlap, piece, weight, even):
    """Cheapest way by trying all ways."""
    best = None
    stack = [(overlap, 0.0, ())]
    while stack:
        at, cost, ends = stack.pop()
        if at == n:
            if best is None or cost < best[0] - 1e-6:
                best = (cost, ends)
            continue
        for p, c in zip(places, costs):
            if at < p <= at + limit - overlap:
                off = (p - at) / even - 1
                stack.append((p, cost + c + piece + weight * off * off, (*ends, p)))
    return best


def test_cuts_cost_least():
    import siftlake.llm.splitting as m

    r = random.Random(9)
    for _ in range(15):
        words = ["w" * r.randrange(2, 9) + r.choice([" ", ". ", "\n", "\n\n"]) for _ in range(40)]
        data = "".join(words).encode()
        limit, overlap = 96, 16
        if len(data) <= limit:
            continue
        places, costs = m.boundaries(data, limit - overlap - 4)
        keep = places > overlap
        step = limit - overlap
        even = (len(data) - overlap) / -(-(len(data) - overlap) // step)
        places, costs = places[keep].tolist(), costs[keep].tolist()
        # only places that some cheapest way could use: thin out to keep the brute force small
        want = brute(places[::3] + [len(data)], costs[::3] + [0], len(data), limit, overlap, m.PIECE, m.IMBALANCE, even)
        ends = [e for _, e in m.split_places(data, limit, overlap)]
        cost, at = 0.0, overlap
        by_place = dict(zip(places, costs))
        for e in ends:
            off = (e - at) / even - 1
            cost += by_place[e] + m.PIECE + m.IMBALANCE * off * off
            at = e
        assert want is None or cost <= want[0] + 1e-4


def test_table(spark):
    data = [(1, "short", 0), (2, "a b " * 3000, 0), (None, "c d " * 2000, 0), (3, None, 0), (4, "", 0), (2, "a b " * 3000, 0), (5, "x" * 4096, 0)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, piece_no int")
    got = split_documents(df)
    assert {r[0] for r in got.select("doc_id").collect()} == {2, None}
    assert got.filter("doc_id = 2").count() == 2 * len(split_places(b"a b " * 3000))
    assert rows(got.filter("length(text) != end_token - start_token")) == []
    assert split_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_documents(df, 100, 80)
