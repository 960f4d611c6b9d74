"""Every answer from the histogram against the lengths themselves."""

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from conftest_llm import make, odd_rows, prose

from memspark.llm import token_counts
from memspark.llm.bpe import read_ranks

RANKS = P.path("byte_bpe_50k.tiktoken")
LIBRARY = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def answers(docs, space):
    return token_counts.limits(space.stage(token_counts.histogram(docs, RANKS, P.PATTERN), "lengths"))


@pytest.mark.parametrize("step", [2, 50, 4096])
def test_all_limits(spark, odd, space, monkeypatch, step):
    monkeypatch.setattr(token_counts, "STEP", step)
    rows = odd_rows() + [(100 + i, prose(i, i % 23), "s") for i in range(150)]
    lengths = np.array([len(LIBRARY.encode_ordinary(t or "")) for _, t, _ in rows])
    got = answers(make(spark, rows).repartition(3), space).cache()
    table = {r["n_tokens"]: r for r in got.collect()}
    assert sorted(table) == sorted(set(lengths.tolist()))
    for n, r in table.items():
        assert r["documents"] == (lengths == n).sum()
        assert r["documents_longer"] == (lengths > n).sum()
        assert r["tokens_upto"] == lengths[lengths <= n].sum()
        assert r["truncated_total"] == np.minimum(lengths, n).sum()
        assert r["share_upto"] == pytest.approx((lengths <= n).mean())
    for limit in (0, 1, 7, 33, 1000, 10**6):
        assert token_counts.truncated_total(got, limit) == np.minimum(lengths, limit).sum()
    for share in (0.0, 0.1, 0.5, 0.9, 1.0):
        assert token_counts.quantile(got, share) == min(n for n in set(lengths.tolist()) if (lengths <= n).mean() >= share - 1e-12)


def test_empty_table(spark, empty, space):
    got = answers(empty, space)
    assert got.count() == 0
    assert token_counts.quantile(got, 0.5) is None
    assert token_counts.truncated_total(got, 10) == 0


def test_no_plan_sends_all_lengths_to_one_task(spark, odd, space):
    """The windows without keys run over sums of ranges only."""
    text = answers(odd, space)._jdf.queryExecution().optimizedPlan().toString()
    for line in text.splitlines():
        if "Window" in line and "n_tokens" in line.split("], [")[-1]:
            assert "step" in line
