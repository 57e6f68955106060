from herdbook.operators.hotdeck import Deck, Gap, fill, hot_deck

SCHEMA = "row_id bigint, cell string, area string, iso string, yr int, pop double, gdp double, urban int, donors string"
GAPS = [Gap("gdp", above=0, codes=(-9999.0,)), Gap("urban", kind="class", above=0, below=100)]
DECK = Deck("row_id", "cell", "area", "iso", "yr", ("pop",), k=3)


def test_donors_come_from_cell_then_area(spark):
    rows = [(1, "a", "A", "X", 2015, 10.0, None, 11, ""), (2, "a", "A", "X", 2018, 10.0, 5.0, -200, ""), (3, "a", "A", "X", 2020, 11.0, 6.0, 11, ""),
            (4, "b", "A", "X", 2015, 10.0, float("nan"), None, ""), (5, "c", "A", "X", 2015, 10.5, 7.0, 12, ""), (6, "d", "A", "X", 2015, 9.5, 7.5, 12, ""), (7, "e", "A", "X", 2015, 10.2, 8.0, 12, ""), (8, None, None, None, None, None, -9999.0, 12, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = hot_deck(df, GAPS, DECK)
    got = {(r.row_id, r.field_name): r for r in found.collect()}
    assert set(got) == {(1, "gdp"), (4, "gdp"), (8, "gdp"), (2, "urban"), (4, "urban")}
    assert all(r.filled for r in got.values())
    assert got[1, "gdp"].tier == "cell" and got[1, "gdp"].filled_value in (5.0, 6.0)
    assert got[4, "urban"].filled_value == 12 and got[4, "gdp"].tier != "cell" and set(got[4, "gdp"].donors) <= {5, 6, 7}
    out = {r.row_id: r for r in fill(df, found, GAPS, "row_id").collect()}
    assert out[1].gdp_filled and not out[5].gdp_filled and out[5].gdp == 7.0 and out[2].urban == 11


def test_nobody_has_a_value_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a", "A", "X", 2015, 1.0, None, 11, "")], SCHEMA)
    r = hot_deck(df, GAPS, DECK).collect()
    assert len(r) == 1 and not r[0].filled and r[0].tier == "none"
    assert hot_deck(df.where("false"), GAPS, DECK).count() == 0


def test_the_copied_value_is_a_donor_s_own(spark):
    rows = [(i, "a" if i < 3 else f"c{i}", "A", "X", 2015, 10.0 + i, None if i in (1, 5) else float(i), 11, "") for i in range(1, 9)]
    for deck in (DECK, Deck("row_id", None, "area", "iso", "yr", ("pop",), classes=("urban",), k=3)):
        for r in hot_deck(spark.createDataFrame(rows, SCHEMA), GAPS, deck).collect():
            assert r.filled_value == float(r.donor) and r.donor in r.donors


def test_a_hot_block_of_copies(spark):
    n = 30_000  # alike donors beside as many gaps, all in one block
    one = spark.range(n).selectExpr("id AS row_id", "concat('c', id) AS cell", "'A' AS area", "'X' AS iso", "2015 AS yr", "10.0D AS pop", "if(id % 2 = 0, 7.0D, null) AS gdp", "11 AS urban", "'' AS donors")
    got = hot_deck(one, GAPS, Deck("row_id", "cell", "area", "iso", "yr", ("pop",), k=3)).groupBy("filled_value", "donors").count().collect()
    assert [(r.filled_value, r.donors, r["count"]) for r in got] == [(7.0, [0, 2, 4], n // 2)]
