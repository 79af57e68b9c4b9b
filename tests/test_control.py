import time

import pytest

from lodestream.operators.control import Control, run_or_serial, scan_controlled, time_limit
from lodestream.plans import walk
from lodestream.plans.model import Collection, JsonError, Request

REQUEST = Request((Collection(),))


def test_controls_stop_and_order():
    assert scan_controlled("[1,2]", REQUEST, Control()) == walk.scan("[1,2]", REQUEST)
    for control, code in ((Control(cancelled=True, deadline=0.0), "cancelled"), (Control(deadline=5.0, now=lambda: 6.0), "deadline-exceeded"), (Control(most_bytes=16), "memory-exceeded")):
        with pytest.raises(JsonError) as e:
            scan_controlled("[1,2]", REQUEST, control)
        assert (e.value.cls, e.value.code) == ("Control", code)


def test_serial_fallback():
    def fails(cls):
        def f():
            raise JsonError(cls, "x")

        return f

    assert run_or_serial(True, lambda: 1, lambda: 2) == 1 and run_or_serial(False, lambda: 1, lambda: 2) == 2
    assert run_or_serial(True, fails("Syntax"), lambda: 2) == 2
    with pytest.raises(JsonError):
        run_or_serial(True, fails("Control"), lambda: 2)


def test_jobs_are_cancelled_in_time(spark):
    def slow(batches):
        for b in batches:
            time.sleep(15)
            yield b

    began = time.monotonic()
    with pytest.raises(Exception, match="(?i)cancel"), time_limit(spark, 2):
        spark.range(4).mapInPandas(slow, "id long").collect()
    assert time.monotonic() - began < 12
