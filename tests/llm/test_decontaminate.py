from gazeloom.llm import decontaminate as D
from tests.llm.conftest import prose

ITEM = "Alice walks 12 km in 3 hours and then rests for 20 minutes before she walks another 12 km with Bob at the same speed"
OTHER = "Carol walks 15 km in 4 hours and then rests for 35 minutes before she walks another 15 km with Dave at the same speed"
TWISTED = "Carol walks 15 km in 4 hours and then rests for 35 minutes before she walks another 99 km with Dave at the same speed"


def run(docs, bench):
    return {(r["doc_id"], r["item_id"]): r for r in D.contaminated(docs, bench).collect()}


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, h string") if rows and len(rows[0]) == 3 else spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, h string")


def test_copies_and_new_parameters_are_found_and_others_left(spark, make, odd):
    items = [(7, ITEM), (7, ITEM), (8, None), (9, ""), (10, "Too short"), (None, ITEM), (11, prose(900, 40))]
    rows = odd + [(20, prose(1, 50) + ". " + ITEM + " " + prose(2, 50)), (21, OTHER), (22, prose(5, 300)), (23, ITEM.upper()), (24, ITEM.replace(" ", "\n  ")),
                  (25, ITEM[:40]), (26, prose(1, 20) + " " + prose(900, 40) + " " + ITEM), (20, prose(1, 50) + ". " + ITEM + " " + prose(2, 50))]
    got = run(make(rows), bench(spark, items))
    assert set(got) == {(20, 7), (21, 7), (23, 7), (24, 7), (26, 7), (26, 11)}
    assert got[21, 7]["n_changed"] == 5 and got[20, 7]["n_changed"] == 0 and got[20, 7]["n_covered"] == got[20, 7]["n_words"]


def test_slots_must_agree(spark, make):
    assert D.kind_of("12") == D.NUMBER and D.kind_of("Bob") == D.NAME and D.kind_of("km") == D.UNIT and D.kind_of("walks") == D.LITERAL
    windows = [(0, 4, ["12", "a"], ["15", "b"]), (1, 4, ["12"], ["15"]), (6, 4, ["12"], ["99"])]
    at, changed = D.covered(windows)
    assert at == {0, 1, 2, 3, 4} and changed == 2
    got = run(make([(1, OTHER), (2, TWISTED)]), bench(spark, [(7, ITEM)]))
    assert got[1, 7]["n_covered"] == got[1, 7]["n_words"]
    assert (2, 7) not in got or got[2, 7]["n_covered"] < got[2, 7]["n_words"]


def test_without_the_broadcast_filter(spark, make, odd, monkeypatch):
    rows = odd + [(21, OTHER), (22, prose(5, 300))]
    with_filter = run(make(rows), bench(spark, [(7, ITEM), (11, prose(900, 40))]))
    monkeypatch.setattr(D, "BROADCAST_HASHES", 0)
    assert run(make(rows), bench(spark, [(7, ITEM), (11, prose(900, 40))])) == with_filter and set(with_filter) == {(21, 7)}


def test_short_items_and_empty_tables(spark, make):
    short = "which river crosses seven borders"
    assert set(run(make([(1, "tell me: Which river crosses seven borders?"), (2, "which river crosses borders")]), bench(spark, [(4, short)]))) <= {(1, 4)}
    assert not run(make([(1, ITEM)]), bench(spark, [(7, ITEM)]).where("false"))
    assert not run(make([(1, ITEM)]).where("false"), bench(spark, [(7, ITEM)]))


def test_exact_copies_of_short_number_and_name_items(spark, make):
    names = "which of these children was not at school on the day: Anna Bela Carl Dora Emil Fred Gina Hugo"
    items = ["What is 25% of 360 dollars?", "What is 12 + 15 * 7?", "Natalia has 5 apples, Tom 3, Ann 7, Bob 9, Eve 11.", "Capital of Burkina Faso: Ouagadougou",
             "中华人民共和国的首都是哪里", "日本で一番高い山は何ですか", "ประเทศไทย", "Why", names]
    rows = [(10 + k, f"{prose(k, 30)}. {t} {prose(50 + k, 30)}") for k, t in enumerate(items)]
    rows += [(30 + k, f"{prose(k, 30)}. {t.upper()} {prose(50 + k, 30)}") for k, t in enumerate(items)]
    rows += [(40, "一段话里写着中华人民共和国的首都是哪里这样的问题"), (41, "What is 25% of 361 dollars?"), (42, "中华人民共和国的人口"), (43, prose(3, 90)),
             (44, "Natalia has 6 apples, Tom 3, Ann 7, Bob 9, Eve 12."), (45, names.replace("Fred Gina Hugo", "Finn Gwen Hans").replace("Anna Bela Carl Dora Emil", "Alma Bert Cleo Dirk Elsa"))]
    got = set(run(make(rows), bench(spark, list(enumerate(items)))))
    assert got == {(10 + k, k) for k in range(9)} | {(30 + k, k) for k in range(9)} | {(40, 4), (45, 8)}


def test_given_benchmark(spark):
    """The documents that hold an item word by word are found, and no others."""
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    grams = {}
    for i, t in items.select("item_id", "text").collect():
        w = t.lower().split()
        for k in range(len(w) - 9):
            grams.setdefault(tuple(w[k: k + 10]), set()).add(i)
    want = set()
    for d, t in docs.select("doc_id", "text").collect():
        w = t.lower().split()
        for k in range(len(w) - 9):
            want |= {(d, i) for i in grams.get(tuple(w[k: k + 10]), ())}
    assert set(run(docs, items)) == want and want
