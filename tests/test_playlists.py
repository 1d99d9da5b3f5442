from crateline.operators import playlists


def test_entries_are_matched_once_and_lost_ones_keep_their_repeats(spark):
    catalogue = spark.createDataFrame([(5, "/lib/a.mp3"), (3, "/lib/a.mp3"), (7, "/lib/b/é.mp3"), (9, "/x/a.mp3")], "id long, path string")
    entries = spark.createDataFrame([
        (1, 0, "/lib/./a.mp3"), (1, 1, "/other/é.mp3"), (1, 2, "/lib//a.mp3"), (1, 3, "/no/where.x"), (1, 3, "/no/where.x"), (1, 3, "/no/where.y"),
        (1, None, "/no/where.x"), (2, 0, None), (2, 1, None), (2, 2, "/y/a.mp3"), (None, 4, "/x/a.mp3"),
    ], "playlist long, pos int, path string")
    found = playlists.playlist_positions(entries, catalogue)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert found.columns == ["playlist", "id", "first_pos", "path", "found"]
    assert sorted(map(tuple, found.collect()), key=key) == sorted([
        (1, 3, 0, "/lib/./a.mp3", True), (1, 7, 1, "/other/é.mp3", True), (2, 3, 2, "/y/a.mp3", True), (None, 9, 4, "/x/a.mp3", True),
        (1, None, 3, "/no/where.x", False), (1, None, 3, "/no/where.x", False), (1, None, 3, "/no/where.y", False), (1, None, None, "/no/where.x", False),
        (2, None, 0, None, False), (2, None, 1, None, False)], key=key)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 5  # one over the distinct paths of the entries, the others over the catalogue; 10 when entries went twice
    assert plan.count("Union") == 0
