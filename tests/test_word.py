"""Word-processor files made by hand, and the package as an archive."""

import struct
import subprocess
import sys
import zipfile

import pytest
from gapline.operators import corpus
from gapline.sources import shipping, tables, word

SAID = "Interviewer: How was it?\nInterviewee: Good – “fine”\tand é\nInterviewer: Next one\nInterviewee: no"


def docx(path, text):
    body = "".join(
        "<w:p><w:pPr><w:tabs><w:del/></w:tabs></w:pPr>" + "<w:r><w:tab/></w:r>".join(f"<w:r><w:t xml:space='preserve'>{x}</w:t></w:r>" for x in line.split("\t")) + "</w:p>"
        for line in text.split("\n")
    )
    xml = f"<w:document xmlns:w='{word.W[1:-1]}'><w:body>{body}<w:sectPr/></w:body></w:document>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", xml)


def compound(streams, size=512):
    """A compound file; streams below 4,096 bytes go to the root's stream of small sectors."""
    sectors, chains = [], {}

    def put(data):
        first = len(sectors)
        parts = [data[k : k + size].ljust(size, b"\0") for k in range(0, max(len(data), 1), size)]
        sectors.extend(parts)
        for k in range(first, first + len(parts)):
            chains[k] = k + 1 if k + 1 < first + len(parts) else 0xFFFFFFFE
        return first

    small, small_next, places = b"", [], {}
    for name, data in streams.items():
        if len(data) >= 4096:
            places[name] = put(data)
        else:
            places[name] = len(small_next)
            n = -(-len(data) // 64)
            small_next += [len(small_next) + k + 1 for k in range(n - 1)] + [0xFFFFFFFE]
            small += data.ljust(64 * n, b"\0")
    root = put(small) if small else 0xFFFFFFFE
    mini = put(struct.pack(f"<{len(small_next)}I", *small_next).ljust(size, b"\xff")) if small_next else 0xFFFFFFFE

    def entry(name, kind, start, n):
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<IQ", start, n)

    entries = entry("Root Entry", 5, root, len(small)) + b"".join(entry(n, 2, places[n], len(d)) for n, d in streams.items())
    folder = put(entries.ljust(-(-len(entries) // size) * size, b"\0"))
    table = len(sectors)
    following = [chains.get(k, 0xFFFFFFFF) for k in range(table)] + [0xFFFFFFFD]
    assert len(following) <= size // 4
    sectors.append(struct.pack(f"<{size // 4}I", *following, *[0xFFFFFFFF] * (size // 4 - len(following))))
    head = word.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<8I", 1, folder, 0, 4096, mini, int(bool(small_next)), 0xFFFFFFFE, 0)
    return (head + struct.pack("<109I", table, *[0xFFFFFFFF] * 108)).ljust(512, b"\0") + b"".join(sectors)


def doc(text, flags=0x0200, extra=0, pieces=None, ident=0xA5EC):
    """The text in two pieces, the first in single bytes, the second in UTF-16."""
    text = text.replace("\n", "\r") + "\r"
    cut = text.index("Good")
    one, two = text[:cut].encode("cp1252"), text[cut:].encode("utf-16-le")
    start = 1536
    main = bytearray(start)
    struct.pack_into("<H8xH", main, 0, ident, flags)
    struct.pack_into("<i", main, 0x4C, len(text))
    body = bytes(one).ljust(-(-len(one) // 2) * 2, b"\0")
    ends = (0, cut, len(text))
    pcd = b"".join(struct.pack("<HIH", 0, fc, 0) for fc in (start * 2 | 0x40000000, start + len(body)))
    plc = struct.pack("<3I", *ends) + pcd
    clx = b"\x01" + struct.pack("<H", 4) + b"abcd" + b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", main, 0x1A2, 10, len(clx))
    whole = bytes(main) + body + two + b"\0" * extra
    return compound({"WordDocument": whole, "1Table" if flags & 0x0200 else "0Table": b"\0" * 10 + clx})


@pytest.mark.parametrize("flags,extra", [(0x0200, 0), (0, 6000)])
def test_doc_pieces(flags, extra):
    assert word.doc_text(doc(SAID, flags, extra)) == SAID


def test_doc_marks_and_fields():
    assert word.plain('a\x07b\x0bc\x13 HYPERLINK "x"\x14shown\x15 d\x13 code\x15\x1ee\x1f\x01\r\r') == "a\tb\ncshown d-e\n"


def test_folder_of_documents(spark, tmp_path):
    (tmp_path / "et-1.txt").write_text(SAID, encoding="utf-8-sig")
    docx(tmp_path / "et-2.docx", SAID)
    (tmp_path / "et-3.doc").write_bytes(doc(SAID))
    broken = {
        "a.doc": (b"plain", "neither a compound"),
        "b.docx": (b"PK\x03\x04cut", "zip"),
        "c.doc": (doc(SAID, 0x0300), "encrypted"),
        "d.doc": (doc(SAID, ident=7), "not a Word document"),
        "e.doc": (compound({"Other": b"x" * 100}), "no stream"),
        "f.doc": (doc(SAID)[:900], ""),
        "g.txt": (b"\xff\xfe\x81", "not UTF-8"),
    }
    for name, (contents, _) in broken.items():
        (tmp_path / name).write_bytes(contents)
    got = {r.file_name: r for r in tables.read_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"et-1.txt", "et-2.docx", "et-3.doc", *broken}
    for name, (_, why) in broken.items():
        assert got[name].status == "error" and got[name].text == "" and got[name].error and why.lower() in got[name].error.lower()
    good = tables.read_documents(spark, f"{tmp_path}/et-*")
    turns = corpus.turns(corpus.prepare(good)).select("ID", "Turn_Index", "Speaker", "Turn_Text").collect()
    by = {k: sorted((r.Turn_Index, r.Speaker, r.Turn_Text) for r in turns if r.ID == k) for k in {r.ID for r in turns}}
    assert len(by) == 3 and len({str(v) for v in by.values()}) == 1 and all(len(v) == 4 for v in by.values())


def test_package_as_an_archive(spark, tmp_path):
    path = shipping.archive(f"{tmp_path}/gapline.zip")
    code = "import gapline, gapline.operators.gaps as g; print(gapline.__file__, g.jaccard.__name__)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": path, "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert "gapline.zip" in out.stdout and "jaccard" in out.stdout, out.stderr
    with zipfile.ZipFile(path) as z:
        assert "gapline/models/words16.json" in z.namelist() and not [n for n in z.namelist() if n.endswith(".pyc")]
    shipping.ship(spark)
    assert spark.range(1).rdd.map(lambda _: __import__("gapline").__name__).collect() == ["gapline"]
