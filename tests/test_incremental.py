import pytest

from castlist.plans import incremental
from castlist.sources import files

DOCS = "doc_id string, path string, text string, encoding string"
ROWS = "doc_id string, original string, replacement string, occurrence_count int, rank int"


@pytest.fixture
def export(spark, tmp_path):
    def run(texts, edits):
        docs = spark.createDataFrame([(i, f"{tmp_path}/{i}.txt", text, "utf-8") for i, text in texts.items()], DOCS)
        rows = spark.createDataFrame([(i, a, b, 1, k) for k, (i, a, b) in enumerate(edits)], ROWS)
        return incremental.export_changed(docs, rows, str(tmp_path))

    return run


def content(tmp_path):
    return {p.name: p.read_text() for p in tmp_path.glob("*_processed.txt")}


def runs(export):
    return {r.doc_id: r.run for r in export.manifest.collect()}


TEXTS = {"a": "Ann and Bob", "b": "Bob", "c": "Cid", "d": None}
EDITS = [("a", "Ann", "Eve"), ("a", "Bob", ""), ("b", "Bob", "Rob"), ("c", "Cid", " "), ("d", "x", "y")]


def test_only_what_changed_is_written_again(export, tmp_path):
    first = export(TEXTS, EDITS)
    assert (first.run, first.written, runs(first)) == (1, 2, {"a": 1, "b": 1})
    assert content(tmp_path) == {"a_processed.txt": "Eve and Bob", "b_processed.txt": "Rob"}
    same = export(TEXTS, list(reversed(EDITS[1:])) + EDITS[:1])
    # Another rank is another mapping table for "a", whose rows alone have moved against each other or not.
    assert same.written == sum(r.run == 2 for r in same.manifest.collect())
    again = export(TEXTS, EDITS)
    stamps = {p.name: p.stat().st_mtime_ns for p in tmp_path.glob("*_processed.txt")}
    edited = export(TEXTS, [("a", "Ann", "Eva"), *EDITS[1:]])
    assert (edited.written, runs(edited)) == (1, runs(again) | {"a": 4})
    assert content(tmp_path)["a_processed.txt"] == "Eva and Bob"
    assert (tmp_path / "b_processed.txt").stat().st_mtime_ns == stamps["b_processed.txt"]
    none = export(TEXTS, [("a", "Ann", "Eva"), *EDITS[1:]])
    assert (none.run, none.written, runs(none)) == (5, 0, runs(edited))


def test_changed_texts_new_documents_and_dropped_ones(export, tmp_path):
    export(TEXTS, EDITS)
    second = export(TEXTS | {"b": "Bob Bob", "c": "Cid"}, [EDITS[2], ("c", "Cid", "Sid")])
    assert (second.written, runs(second)) == (2, {"b": 2, "c": 2})
    assert [(r.doc_id, r.run) for r in second.dropped.collect()] == [("a", 1)]
    assert content(tmp_path) == {"a_processed.txt": "Eve and Bob", "b_processed.txt": "Rob Rob", "c_processed.txt": "Sid"}
    totals = {r.doc_id: (r.n_names, r.total) for r in second.manifest.collect()}
    assert totals == {"b": (1, 2), "c": (1, 1)}


def test_a_run_that_dies_leaves_the_manifest(export, tmp_path, monkeypatch):
    export(TEXTS, EDITS)
    changed = [("a", "Ann", "Ida"), *EDITS[1:]]
    real = files.save_files

    def die(texts):
        real(texts)
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(files, "save_files", die)
        with pytest.raises(KeyboardInterrupt):
            export(TEXTS, changed)
    assert content(tmp_path)["a_processed.txt"] == "Ida and Bob"
    after = export(TEXTS, changed)
    assert (after.run, after.written, runs(after)) == (2, 1, {"a": 2, "b": 1})


def test_nothing_at_all(export):
    assert (export({}, []).written, export({}, []).run) == (0, 2)
