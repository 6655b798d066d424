"""The registered search query on a table with non-finite vectors."""

import math

from lexmill.llm import queries
from test_numbers import brute_top

INF, NAN = float("inf"), float("nan")
BAD = [[NAN, 0.5, 0.5, 0.5], [0.5, INF, 0.5, 0.5], [0.5, 0.5, -INF, 0.5], [NAN] * 4, [INF] * 4, [-INF] * 4, [0.5, None, 0.5, 0.5], [], None]


def test_non_finite_vectors_take_no_part(spark, tmp_path):
    rows = [(i, [math.sin(i * (j + 1)) for j in range(4)]) for i in range(1, 160)]
    rows += [(1000 + 50 * i, v) for i, v in enumerate(BAD)] + [(2001 + i, v) for i, v in enumerate(BAD)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    read = spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()
    finite = [r for r in read if r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    whole = [(r["vec_id"], [float(math.floor(256 * x)) for x in r["embedding"]]) for r in finite]
    got = [tuple(r) for r in queries.QUERIES["op7_exact_top_k"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == brute_top(whole, lambda i: i % 50 == 0, 5)
