"""Cells of notebooks."""

import json

import pytest

from strandlog.llm.notebooks import cells


def test_ipynb():
    nb = {
        "cells": [
            {"cell_type": "markdown", "source": ["# A\n", "text"]}, {"cell_type": "code", "source": "x", "outputs": [{"output_type": "output", "text": "1"}, {"output_type": "image", "data": "iVBO"}, {"data": {"image/png": "q", "text/plain": ["a", "b"]}}, {"traceback": ["t1", "t2"]}, 5]},
            {"cell_type": "raw", "source": None}, "no cell",
        ]
    }
    assert cells(json.dumps(nb), "ipynb") == [("markdown", "# A\ntext"), ("code", "x"), ("output", "1"), ("image", "iVBO"), ("image", "q"), ("output", "ab"), ("error", "t1\nt2")]


def test_percent():
    text = "intro\n# %% [markdown]\n# # T\n# \n# body\n\n# %%\nx = 1\n# note\n\n# [out] [INFO] a\n# [INFO] b\n\n# [image] data:image/png;base64,xx\n"
    assert cells(text, "percent") == [("text", "intro\n"), ("markdown", "# T\n\nbody"), ("code", "x = 1\n# note"), ("output", "[INFO] a\n[INFO] b"), ("image", "data:image/png;base64,xx")]


def test_console():
    text = "# T\n\nIn [1]:\nx\ny\n\nOut[1]:\nTraceback (most recent call last)\n\nIn [ ]:\nz\n\nwords"
    assert cells(text, "console") == [("markdown", "# T"), ("code", "x\ny"), ("error", "Traceback (most recent call last)"), ("code", "z"), ("markdown", "words")]


@pytest.mark.parametrize("text", [None, "", " \n"])
def test_nothing(text):
    assert all(cells(text, layout) == [] for layout in (None, "ipynb", "percent", "console", "other"))


def test_broken_and_unknown():
    for layout in ("ipynb", "other", None):
        assert cells('{"cells": [', layout) == [("text", '{"cells": [')]
    assert cells('{"cells": 3}', "ipynb") == []
    assert len(cells("a\n\n" * 50_000, "console")) == 50_000
