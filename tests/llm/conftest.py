import pytest

pytest.importorskip("codeweft.llm")
