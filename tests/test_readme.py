"""Documentation as a test: the README's runnable example executes as written."""

import re
from pathlib import Path

import pytest

README = Path(__file__).resolve().parents[1] / "README.md"


def _runnable_blocks():
    text = README.read_text()
    marker = text.index("tests/test_readme.py` executes this block")
    return re.findall(r"```python\n(.*?)```", text[marker:], re.S)[:1]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001/orders.parquet").exists(), reason="test data absent")
def test_readme_example_runs(spark):
    (block,) = _runnable_blocks()
    exec(compile(block, "README.md", "exec"), {})
