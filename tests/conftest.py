"""One local session for all tests, with its own warehouse and shared folder."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import build_session

    base = tmp_path_factory.mktemp("spark")
    session = build_session("4", 4, spark__sql__warehouse__dir=f"file://{base}/warehouse", spark__checkpoint__dir=f"file://{base}/shared")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
