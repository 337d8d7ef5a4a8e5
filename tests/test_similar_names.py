"""Similar names of a file are found beside their mentions."""

import numpy as np
import pytest

from corvane.operators import canonical as cn
from tests.test_operators import brute_leaders


def similar_mentions(spark, folder):
    """Mentions of four files with typos, repeats in other spellings, aliases and a mention without file."""
    rng = np.random.default_rng(5)
    base = ["tran thi binh", "red widget large", "acme corporation", "blue ring nine", "Sai Gon", "Saigon"]
    rows = []
    for at in map(int, rng.permutation(320)):
        name = base[int(rng.integers(len(base)))]
        if rng.random() < 0.7 and name not in ("Sai Gon", "Saigon"):
            i = int(rng.integers(len(name)))
            name = name[:i] + rng.choice(list("abx")) + name[i + 1:]
        name = rng.choice([name, name.upper(), f" {name}!"])
        rows.append(("o" if at % 7 else "p", f"f{at % 4}" if at % 40 else None, "c", at, str(name),
                     ["tool", "Concept"][at % 5 == 0], "", ""))
    spark.createDataFrame(rows, "owner_id string, file_id string, chunk_id string, ord int, raw_name string, "
                          "raw_type string, subtype string, description string").write.parquet(folder)
    return spark.read.parquet(folder), rows


@pytest.mark.parametrize("few", [True, False])
def test_similar_names_of_files_against_brute_force(spark, tmp_path, monkeypatch, few):
    """Small groups beside their mentions, larger ones by rounds; names as numbers or as they are."""
    m, rows = similar_mentions(spark, f"{tmp_path}/m")
    if not few:
        monkeypatch.setattr(cn, "broadcast_if_small", lambda df: df)
    got = {r["ord"]: (r["name"], r["name_norm"]) for r in cn.resolve_entities(m, cn.alias_table(spark)).collect()}
    want, files = {}, {}
    for owner, file, _, at, raw, kind, *_ in sorted(rows, key=lambda r: r[3]):
        clean = raw.strip()
        norm = clean.strip("!").lower()
        if norm.replace(" ", "") == "saigon":
            clean, norm = "TP. Hồ Chí Minh", "tp ho chi minh"
            want[at] = (clean, norm)
        elif file is None:
            want[at] = (clean, norm)
        if file is not None:
            files.setdefault((owner, file, kind), []).append((at, norm, clean))
    for told in files.values():
        first = {}
        for _, norm, clean in told:
            first.setdefault(norm, clean)
        lead = brute_leaders(list(first))
        for at, norm, _ in told:
            want.setdefault(at, (first[lead[norm]], lead[norm]))
    assert got == want


def test_mentions_are_shuffled_once_for_similar_names(spark, tmp_path):
    m, _ = similar_mentions(spark, f"{tmp_path}/m")
    few = m.filter("lower(raw_name) like '%acme corporation%' or raw_name = 'Saigon'")
    plan = cn.resolve_entities(few, cn.alias_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
