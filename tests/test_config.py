import pytest
from codeloom.sources.config import clamped, is_context_length, is_transient, load_dotenv, retried, should_track, threshold


def test_dotenv():
    assert load_dotenv("# c\n\nA=1\nB = 'x=y'\nC\nD=\"q\"\n", {"A": "real"}) == {"A": "real", "B": "x=y", "D": "q"}


def test_paths_and_limits():
    assert should_track("src/a.ts") and not should_track("/node_modules/a") and not should_track("")
    assert clamped() == (8, 700) and clamped(1, 1) == (5, 100) and clamped(50, 5000) == (10, 5000)


@pytest.mark.parametrize("value,want", [(1, 1.0), (50, 0.5), (1.5, 0.015), (-1, 0.0), (float("nan"), 0.3), (None, 0.3)])
def test_thresholds(value, want):
    assert threshold(value, 0.3) == want


def test_errors():
    assert is_transient("ThrottlingException: slow") and not is_transient("bad key")
    assert is_context_length("the input length exceeds context length") and not is_context_length("no")
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("connection reset")
        return "ok"

    assert retried(flaky, pause_s=0) == "ok" and len(calls) == 3
    with pytest.raises(ValueError):
        retried(lambda: (_ for _ in ()).throw(ValueError("bad")), pause_s=0)
