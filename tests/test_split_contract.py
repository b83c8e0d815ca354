"""Partition proofs of splits, on splits with one fault each."""

from signalharm.operators.splits import split_contract

ITEMS = [(s, i, "ab"[i % 2]) for s in ("good", "open", "twice", "odd", "alone", "null") for i in range(6)]
GOOD = [(i, "query" if i < 2 else "library") for i in range(6)]


def test_split_contract(spark):
    roles = [("good", *r) for r in GOOD]
    roles += [("open", *r) for r in GOOD[:-1]]  # an item without a role
    roles += [("twice", *r) for r in GOOD] + [("twice", 0, "library"), ("twice", 3, "library")]
    roles += [("odd", *r) for r in GOOD] + [("odd", 77, "library"), ("odd", None, "query")]
    roles += [("alone", i, "query" if i % 2 else "library") for i in range(6)]  # class b has queries only
    roles += [("null", i, None if i == 5 else r) for i, r in GOOD]
    items = spark.createDataFrame(ITEMS, "split string, id long, class string")
    given = spark.createDataFrame(roles, "split string, id long, role string")
    got = {r.split: r for r in split_contract(items, given, ["split"], "id", "class").collect()}
    names = ["n_items", "n_unassigned", "n_repeated", "n_conflicts", "n_unknown", "n_absent_class", "complete", "valid"]
    assert {k: [r[n] for n in names] for k, r in got.items()} == {
        "good": [6, 0, 0, 0, 0, 0, True, True],
        "open": [6, 1, 0, 0, 0, 0, False, False],
        "twice": [6, 0, 2, 1, 0, 0, False, False],
        "odd": [6, 0, 0, 0, 2, 0, False, False],
        "alone": [6, 0, 0, 0, 0, 3, True, False],
        "null": [6, 1, 0, 0, 0, 0, False, False],
    }


def test_split_contract_of_nothing(spark):
    items = spark.createDataFrame([], "split string, id long, class string")
    roles = spark.createDataFrame([], "split string, id long, role string")
    assert split_contract(items, roles, ["split"], "id", "class").count() == 0
