"""Vector codes against plain Lloyd rounds over all distances."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import oracles
from tessera.llm import vector_codes as codes
from tessera.llm.vector_codes import vector_codes


def restated(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    whole = [np.floor(np.array(v + [0.0] * (parts * width - len(v))) * 1024).astype(np.int64).reshape(parts, width) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    books = [np.array([whole[k][m] for k in order[:entries]]) for m in range(parts)]
    assign = lambda: [[((books[m] - w[m]) ** 2).sum(1).argmin() for w in whole] for m in range(parts)]
    for _ in range(rounds):
        now = assign()
        for m in range(parts):
            for j in range(len(books[m])):
                own = [w[m] for w, a in zip(whole, now[m], strict=True) if a == j]
                if own:
                    books[m][j] = [int(s) // len(own) for s in np.sum(own, axis=0)]
    now = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e.tolist()).encode()).hexdigest()
    errors = [int(sum(((books[m][now[m][k]] - w[m]) ** 2).sum() for m in range(parts))) for k, w in enumerate(whole)]
    sums = defaultdict(int)
    for (_, _, label), e in zip(kept, errors, strict=True):
        sums[label] += e
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    return sorted([(i, "".join(f"{now[m][k]:02x}" for m in range(parts)), errors[k], sums[label], digest) for k, (i, _, label) in enumerate(kept)], key=key), key


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).withColumns({c: F.lit(1) for c in ("id", "code", "error", "own", "vector", "parts")})


def cases():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    rows = [(int(i * 7 % 901), (centres[i % 12] + rng.normal(size=8) * 0.1).tolist(), int(i % 3) if i % 5 else None) for i in range(900)]
    rows += [(None, [0.5] * 8, 1), (5, rows[0][1], 1), (5, rows[0][1], 1), (7, None, 2), (8, [float("nan")] * 8, 2), (9, [None] + [0.0] * 7, 2), (10, [float("inf")] * 8, 2), (11, [float("-inf")] + [1.0] * 7, None)]
    yield rows
    yield [(i, [0.25, -0.25, 0.0, 1.0], None) for i in range(300)]  # ties
    yield [(1, [1.0], 0), (2, [], 0), (3, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (4, [0.0001, -0.0001], 1)]
    yield [(i, [float(x) for x in rng.integers(-100_000, 100_000, 4)], i % 2) for i in range(400)]  # beyond what products of floats hold


@pytest.mark.parametrize("case", range(4))
def test_equals_plain_rounds(spark, case):
    rows = list(cases())[case]
    want, key = restated(rows)
    got = vector_codes(frame(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == want


def test_rounds_measure_fewer_parts(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").union(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    _, _, _, measured = codes._trained(vectors, "vec_id", "embedding", "label")
    assert len(measured) == 5 and measured[0] == 4 * vectors.count()
    assert all(m < measured[0] for m in measured[1:])


def test_none_kept_and_too_large(spark):
    rows = [(1, None, 1), (2, [None], 1)]
    assert vector_codes(frame(spark, rows)).collect() == vector_codes(frame(spark, rows).limit(0)).collect() == []
    with pytest.raises(ValueError):
        vector_codes(frame(spark, [(1, [1e30], 1)]))


def test_whole_table(spark):
    rows = [(r[0], r[1], r[2]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want, key = restated(rows)
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    assert sorted(con.execute(oracles.op11()).fetchall(), key=key) == want
    assert sorted(map(tuple, vector_codes(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect()), key=key) == want
