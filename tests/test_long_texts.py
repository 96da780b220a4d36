"""Every operator of the core over texts that are long and awkward; none may fail or hang."""

import time

from pagemill.operators import chunks, cleaning, export, intake

N = 40_000
BAD = ["." * N + "a", " " * N + "a", "x" + " " * N + "y", "a" * N, "- " * N, "a " * N, "\n" * N + "x", "a-" * N, "…" * N, "आ" * N, "{{" * N, "1" * N, '{"a": "' + "b" * N + '"}', '{"a":' * 2000, "a: b\n" * N, "", None]


def pages(spark):
    return spark.createDataFrame([("j", i, i, "https://s.example/", f"https://s.example/{i}", t and t[:50], t) for i, t in enumerate(BAD)], "job_id string, page_id bigint, page_idx int, seed_url string, url string, title string, content string")


def test_core_over_awkward_texts(spark):
    t = time.time()
    p = pages(spark).cache()
    assert cleaning.clean_pages(p, None)[0].count() > 0
    assert export.named_pages(p).count() == len(BAD)
    assert chunks.chunks(p).count() > 0
    assert p.select(intake.clean_text("content"), intake.layer_quality("content")).where("true").count() == len(BAD)
    p.select(intake.clean_text("content").alias("a"), intake.layer_quality("content").alias("b")).write.format("noop").mode("overwrite").save()
    assert time.time() - t < 180
