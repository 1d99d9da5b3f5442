import os

from crateline.sources import catalogue_files, file_tree, playlist_files

from conftest import rows


def test_hidden_names_links_and_skipped_folders(spark, tmp_path):
    for name in (".a.mp3", "_b.mp3", "c/d/e.txt", "c/_DUPLICATES_TO_DELETE/f.mp3", "c/.g/h.flac", "._i.mp3"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * len(name))
    (tmp_path / "empty").mkdir()
    os.symlink(tmp_path / "c", tmp_path / "to_folder")
    os.symlink(tmp_path / "_b.mp3", tmp_path / "to_file.mp3")
    os.symlink(tmp_path / "gone", tmp_path / "to_nothing")
    expected = {".a.mp3": 6, "_b.mp3": 6, "c/d/e.txt": 9, "c/.g/h.flac": 11, "._i.mp3": 7, "to_file.mp3": 6}
    for folders in (0, 1, 3, 256):  # all by one task, or every folder by its own
        found = file_tree.tree(spark, f"file://{tmp_path}", ("_DUPLICATES_TO_DELETE",), folders).collect()
        assert {os.path.relpath(r["path"], tmp_path): r["size"] for r in found} == expected and len(found) == len(expected)
    audio = catalogue_files.manifest(spark, str(tmp_path), audio_only=True)
    assert {os.path.relpath(r["path"], tmp_path) for r in audio.collect()} == {".a.mp3", "_b.mp3", "c/.g/h.flac", "to_file.mp3"}
    assert catalogue_files.manifest(spark, str(tmp_path), audio_only=True, quarantined=True).count() == 5


def test_what_cannot_be_looked_at_is_told(spark, tmp_path):
    (tmp_path / "a.mp3").write_text("x")
    missing = str(tmp_path / "nowhere")
    assert [(r["path"], "No such file" in r["reason"]) for r in catalogue_files.unreadable(spark, missing).collect()] == [(missing, True)]
    assert catalogue_files.unreadable(spark, str(tmp_path)).count() == 0 and catalogue_files.manifest(spark, missing).count() == 0

    def listed(folder):
        return ([(f"{folder}/x", 1, 0.0, None)], [f"{folder}/in", f"{folder}/shut"]) if folder == "/r" else ([(folder, None, None, "denied")], []) if "shut" in folder else ([], [])

    assert sorted(file_tree.below("/r", frozenset(), listed)) == [("/r/shut", None, None, "denied"), ("/r/x", 1, 0.0, None)]
    lost = spark.createDataFrame([(missing, 10)], "path string, size long")
    assert [r["offset"] for r in file_tree.read_lines(lost).filter("reason LIKE '%No such file%'").collect()] == [0]


def test_lines_are_the_same_however_a_file_is_cut(spark, tmp_path):
    texts = {"a": "one\n\ntwo \u00e9\r\n" + "long " * 40 + "\nlast", "b": "\n\n\n", "c": "", "d": "only\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    expected = []
    for name, text in texts.items():
        at = 0
        for line in text.encode().splitlines(keepends=True):
            expected.append((name, at, line.decode().rstrip("\r\n")))
            at += len(line)
    for prefix in ("", "file://"):
        files = spark.createDataFrame([(f"{prefix}{tmp_path}/{n}", os.path.getsize(tmp_path / n)) for n in texts], "path string, size long")
        for split in (1, 7, 50, 1 << 20):
            found = file_tree.read_lines(files, split).collect()
            assert sorted((os.path.basename(r["path"]), r["offset"], r["line"]) for r in found) == sorted(expected)


def test_playlists_of_a_pattern(spark, tmp_path):
    for name in ("_one.m3u8", "two.m3u8", ".three.m3u8", "note.txt"):
        (tmp_path / name).write_text("#EXTM3U\n/" + name + "\n")
    assert rows(playlist_files.read_m3u8(spark, str(tmp_path / "*.m3u8")), "playlist", "path") == [("_one", "/_one.m3u8"), ("two", "/two.m3u8")]
    assert rows(playlist_files.read_m3u8(spark, str(tmp_path / ".*.m3u8")), "playlist") == [(".three",)]
    assert rows(playlist_files.read_m3u8(spark, str(tmp_path)), "playlist") == [("_one",), ("note",), ("two",)]
