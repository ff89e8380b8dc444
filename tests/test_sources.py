"""Collections and landed pages."""

from pyspark.sql import functions as F

from harvestry.sources import collections as C


def test_collections(spark, tmp_path):
    path, schema = f"{tmp_path}/c", "k long, v string, t long"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert C.read_collection(spark, path, schema).count() == 0
    C.merge_into(rows((1, "a", 1), (2, "b", 1)), path, ["k"], ["t"])
    C.merge_into(rows((1, "new", 2), (2, "older", 0), (3, "c", 1)), path, ["k"], ["t"])
    assert sorted(map(tuple, C.read_collection(spark, path, schema).collect())) == [(1, "new", 2), (2, "b", 1), (3, "c", 1)]
    C.merge_into(rows((1, "ignored", 9), (4, "d", 1)), path, ["k"], ["t"], only_new=True)
    assert sorted(r.k for r in C.read_collection(spark, path, schema).collect()) == [1, 2, 3, 4]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["c"]


def test_versions(spark, tmp_path, monkeypatch):
    import pytest

    path, schema = f"{tmp_path}/c", "k long"
    rows = lambda *r: spark.createDataFrame([(x,) for x in r], schema)
    read = lambda: sorted(r.k for r in C.read_collection(spark, path, schema).collect())
    assert C.collection_is_empty(spark, path, schema)
    C.write_collection(rows(1), path)
    old = C.read_collection(spark, path, schema)
    C.write_collection(rows(2, 3), path)
    assert [r.k for r in old.collect()] == [1] and read() == [2, 3]  # who has begun with a version can end with it
    (tmp_path / "c" / "v000000000009-crashed").mkdir()  # rows without a marker are never read
    C.write_collection(rows(4), path)
    assert read() == [4] and not C.collection_is_empty(spark, path, schema)
    (tmp_path / "c" / "_numbers" / "v000000000003").touch()
    monkeypatch.setattr(C, "_versions", lambda s, p, folder="_finished", f=C._versions: f(s, p) if folder == "_finished" else f(s, p, folder)[:-1])
    with pytest.raises(RuntimeError):
        C.write_collection(rows(5), path)
    assert read() == [4]


def test_bounded_texts(spark, tmp_path):
    import gzip

    (tmp_path / "a.xml.gz").write_bytes(gzip.compress("žltý kôň ".encode() * 1000))
    (tmp_path / "b.xml").write_bytes(b"plain text")
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"cut off" * 100)[:-20])
    got = {r.path[-4:]: r.text for r in C.read_texts(spark, str(tmp_path), 24).collect()}
    assert got[".xml"] == "plain text"
    assert got["l.gz"] == "žltý kôň žltý kô" and got["c.gz"] and ("cut off" * 100).startswith(got["c.gz"])


def test_shared_folder_is_asked_for(spark, monkeypatch):
    import pytest

    from harvestry.sources import tables

    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        sparkContext = Context

    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        with pytest.raises(RuntimeError):
            tables.shared_dir(Session)


def test_landed_pages(spark, tmp_path):
    (tmp_path / "a.html").write_bytes('<meta charset="iso-8859-1"><p>Šaty a café</p>'.encode("iso-8859-1", "replace"))
    (tmp_path / "b.html").write_bytes("<meta charset=unknown-1><script>x</script><p>Čaj</p>".encode())
    rows = {r.path[-6:]: r for r in C.read_pages(spark, str(tmp_path)).collect()}
    assert "café" in rows["a.html"].html and "Čaj" in rows["b.html"].html
    same = spark.range(1).select(F.sha1(F.lit("Čaj").cast("binary"))).first()[0]
    assert rows["b.html"].hash == same


def test_selectors():
    from harvestry.functions.html import parse

    root = parse("<ul id=x class='a b'><li>One<li class=c><a href=/2>Two &amp; a half</a><br></ul><div><li>Other</li></div>")
    assert [n.text() for n in root.select("ul li")] == ["One", "Two & a half"]
    assert [n.text() for n in root.select("#x > li.c, div > li")] == ["Two & a half", "Other"]
    assert root.select("a[href=/2]")[0].attrs == {"href": "/2"} and root.select("ul.a.b li a[href]") and not root.select("div a")
    import pytest

    for bad in ("li:first-child", "> ", "", "a >"):
        with pytest.raises(ValueError):
            root.select(bad)


def test_places():
    from harvestry.functions.places import split

    towns = {"kosice": ("Košice", None), "sever": ("Sever", "Košice"), "zilina": ("Žilina", None)}
    assert split("Dom umenia, Hlavná 12, 040 01 Košice", towns) | {} == {"name": "Dom umenia", "street": "Hlavná 12", "postcode": "040 01", "city": "Košice", "district": None, "online": False, "several": None}
    assert split("Klub, Sever", towns)["district"] == "Sever" and split("Klub, Sever", towns)["city"] == "Košice"
    assert split("Žilina, Košice", towns)["several"] == ["Žilina", "Košice"] and split("Online (Zoom)", towns)["online"]
    assert split("Filharmónia Košice", towns)["city"] == "Košice" and split(None, towns)["city"] is None


def test_discard(spark):
    from harvestry.sources.tables import discard, keep

    first, second = keep(spark.range(10), "first"), keep(spark.range(0), "second")
    files = first.inputFiles()
    discard(first, second)
    import os

    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
