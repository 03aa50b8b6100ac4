"""Stored images are packed in tasks of bounded pixels."""

import re

from test_chains import RUNS, noisy

from rasterecho.operators import step
from rasterecho.plans import resume
from rasterecho.plans.scan import feedback_scan


def test_resume_packs_in_tasks_of_bounded_pixels(spark, monkeypatch):
    """Stored images become lines in as many tasks as their pixels fill; they were merged by the size of their files."""
    monkeypatch.setattr(step, "PIXELS_PER_TASK", 10)
    px = noisy(spark, "s")
    done = feedback_scan(px, RUNS[:1], counters=False).pixels().drop("cov")
    last = spark.createDataFrame([("hard", "s", 4)], "run_id string, seq string, frame int")
    plan = resume.resume_hard(done, px, last)._jdf.queryExecution().optimizedPlan().toString()
    assert len(set(re.findall(r"RepartitionByExpression \[(?:run_id.*)?seq.*\], 4\b", plan))) >= 2, plan
