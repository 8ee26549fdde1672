"""Scratch tables end when they are told to."""

import os
import subprocess
import sys

from basalt import workspace


def test_scratch_is_dropped(spark):
    workspace.drop_scratch()
    scratch = workspace.Scratch(spark, "test")
    assert scratch.table("one", spark.range(5)).count() == 5
    folder = scratch.root.removeprefix("file:")
    assert os.path.isdir(folder)
    workspace.drop_scratch()
    assert not os.path.exists(folder) and not workspace._LIVE


def test_a_library_that_is_not_installed_is_no_missing_subpackage(tmp_path):
    """Only the subpackage itself may be left out; an import that fails inside it is an error."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['pyarrow'] = None; import __spark_entry__"
    if os.path.isdir(f"{top}/basalt/llm"):
        done = subprocess.run([sys.executable, "-c", code], cwd=top, capture_output=True, text=True)
        assert done.returncode and "pyarrow" in done.stderr
