"""Groups of near copies: their pairs are not all made, and their components are whole."""

from tabprep.llm import jaccard


def _copies(n: int) -> list[tuple[int, str]]:
    words = [f"w{k}" for k in range(200)]
    return [(i, " ".join([*words[:10 * i + 5], f"x{i}", *words[10 * i + 6:]])) for i in range(n)]


def test_a_group_of_near_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    checked, check = [], jaccard._check

    def counted(pairs, *rest):
        checked.append(pairs.count())
        return check(pairs, *rest)

    monkeypatch.setattr(jaccard, "_check", counted)
    rows = _copies(15) + [(100 + i, " ".join(f"y{i}_{k}" for k in range(30))) for i in range(3)]
    found = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: 0 if i < 100 else i for i, _ in rows}
    assert sum(checked) < 15 * 14 // 2


def test_an_n_gram_that_stands_late_makes_no_pair(spark):
    # two sets of 20 n-grams link with 19 in common, so the first one in common is the first or second of either
    pairs = spark.createDataFrame([(20, 0, 20, 0), (20, 1, 20, 1), (20, 2, 20, 0), (20, 0, 10, 0)], "n long, place int, m long, at int")
    assert [r.early for r in pairs.select(jaccard._early(85, 100).alias("early")).collect()] == [True, True, False, False]
