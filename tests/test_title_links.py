"""Links by title are those of all articles, not of the first ones of equal titles of a slot."""

from marlstone.plans import refinement
from tests.test_pairs import SequenceMatcher


def tables(spark, folder, rows):
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


#: One article a minute: 0 and 110 share a slot, 125 is in the next, only 110 is within two hours of it; 111 equals 110 in title alone.
ROWS = {
    0: "Bank raises rates again. Oil and gas were traded at length over quiet markets of spring",
    110: "Bank raises rates again. Every harbour of northern islands reported snow, storms, fog",
    111: "Bank raises rates again. Football clubs signed seven players from several continents",
    125: "Bank raised rates once again. Museums opened rooms full of porcelain, amber, silver",
    300: "Cows cannot swim. Astronomers counted moons, rings, comets around distant giants",
}


def test_no_pair_within_two_hours_is_lost(spark, tmp_path):
    got = {tuple(r) for r in refinement.title_links(spark, tables(spark, str(tmp_path), ROWS)).collect()}
    titles = {i: "".join(t.split(".")[0].lower().split()) for i, t in ROWS.items()}
    alike = lambda a, b: a in b or b in a or SequenceMatcher(None, b, a).ratio() > 0.5
    assert got == {(a, b) for a in ROWS for b in ROWS if a < b <= a + 120 and alike(titles[a], titles[b])}
    assert {(0, 110), (0, 111), (110, 111), (110, 125), (111, 125)} == got


def test_the_lane_drops_equal_titles_of_a_slot(spark, tmp_path):
    kept = {r.id: r.kept for r in refinement.long_lane(spark, tables(spark, str(tmp_path), ROWS)).collect()}
    assert kept == {0: True, 110: False, 111: False, 125: True, 300: True}  # 110, near 125, is gone itself
