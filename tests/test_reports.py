import json
import sys

from pyspark import cloudpickle

from folioflow import cli
from folioflow.operators import reports

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def runs_file(path):
    rows = []
    for i in range(6):
        run = {"kind": "seal" if i % 2 else "diagram", "rag_value": "low", "detail_level": "short", "raw_text": "<raw>", "price": {"total_cost_usd": 0.5}}
        rows.append({"ref": {"middle_json_path": "/x/__data/f.pdf/middle.json", "pdf_path": "/x/f.pdf", "page_idx": i // 2, "image_path": "i.png"}, "model": f"m{i % 2}", "thinking": None, "latency_sec": 1.0 + i % 2, "status": {"ok": True}, "run": run})
    rows.append({"ref": rows[0]["ref"], "model": "m0", "latency_sec": 1.0, "status": {"ok": False, "error": "late & <bad>"}})
    path.write_text("\n".join(map(json.dumps, rows)) + "\n")
    gold = [{"item_key": f"/x/__data/f.pdf/middle.json::{p}::None::i.png", "kind": "seal", "rag_value": "low", "detail_level": "short", "notes": ""} for p in range(3)]
    (path.parent / "gold.json").write_text(json.dumps({"items": gold}))
    return str(path), str(path.parent / "gold.json")


def text_of(path):
    return "\n".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_reports(spark, tmp_path):
    runs, gold = runs_file(tmp_path / "runs.jsonl")
    assert cli.main(["gold-report", runs, gold, "--out", str(tmp_path / "r.md"), "--html", str(tmp_path / "r.html"), "--charts", str(tmp_path / "c")], spark) == 0
    md = (tmp_path / "r.md").read_text()
    assert "Best: m1 (1.000)" in md and "Fastest: m0 (1.00s)" in md and "`seal` → `diagram` (3)" in md and "Items: 3" in md
    page = (tmp_path / "r.html").read_text()
    assert "<h1>Image screening</h1>" in page and page.count("<table>") == page.count("</table>") == 3
    assert all((tmp_path / "c" / f"{n}.svg").read_text().startswith("<svg") for n in ("cost", "overall", "scores"))
    assert cli.main(["understanding-report", runs, "--out", str(tmp_path / "u.md")], spark) == 0
    assert "| m0 [thinking=null] | 4 | 3 | 1 | 75.0% |" in (tmp_path / "u.md").read_text()


def test_pages(spark, tmp_path):
    runs, gold = runs_file(tmp_path / "runs.jsonl")
    assert cli.main(["view", runs, "--out", str(tmp_path / "v")], spark) == 0
    page = text_of(tmp_path / "v")
    assert page.startswith("<!doctype html>") and page.rstrip().endswith("</html>") and page.count("<section>") == 7
    assert "&lt;raw&gt;" in page and "late &amp; &lt;bad&gt;" in page and "m0, m1" in page
    assert cli.main(["annotate", runs, "--model", "m0", "--seed", gold, "--out", str(tmp_path / "a")], spark) == 0
    page = text_of(tmp_path / "a")
    assert page.count("data-item=") == 3 and page.count("<option selected>seal</option>") == 3 and "gold.json" in page


def test_layout_commands(spark, tmp_path, capsys):
    image = {"type": "image", "index": 1, "blocks": [{"type": "image_body", "lines": [{"spans": [{"type": "image", "image_path": "i.png"}]}]}]}
    doc = {"pdf_info": [{"page_idx": 0, "page_size": [1, 1], "para_blocks": [{"type": "title", "lines": [{"spans": [{"type": "text", "content": "T"}]}]}, image]}]}
    folder = tmp_path / "x" / "__data" / "f.pdf"
    folder.mkdir(parents=True)
    (folder / "middle.json").write_text(json.dumps({"middle": doc, "source_path": "f.pdf"}))
    assert cli.main(["validate", str(tmp_path / "x")], spark) == 0 and "files=1 failed=0" in capsys.readouterr().out
    assert cli.main(["render", str(tmp_path / "x"), "--outdir", str(tmp_path / "md"), "--link-pdf"], spark) == 0
    assert (tmp_path / "md" / "f.pdf" / "text.md").read_text().endswith("/x/f.pdf)\n\n## T")
    for kind in ("txt", "json", "html"):
        assert cli.main(["refs", str(tmp_path / "x"), "--out", str(tmp_path / kind), "--format", kind], spark) == 0
    assert text_of(tmp_path / "txt").strip().endswith("/x/__data/f.pdf/images/i.png")
    assert json.loads(text_of(tmp_path / "json"))["section_title"] == "T" and "#page=1" in text_of(tmp_path / "html")
    (tmp_path / "list.txt").write_text(text_of(tmp_path / "txt"))
    assert cli.main(["refs", str(tmp_path / "x"), "--out", str(tmp_path / "l"), "--list", str(tmp_path / "list.txt")], spark) == 0
    (folder / "middle.json").write_text("{")
    assert cli.main(["validate", str(tmp_path / "x")], spark) == 1


def extract(raw, options):
    lines = raw.decode().split("\n")
    page = {"page_idx": 0, "page_size": [9, 9], "para_blocks": [{"type": "text", "lines": [{"spans": [{"type": "text", "content": x}]}]} for x in lines]}
    body = {"type": "image_body", "lines": [{"spans": [{"type": "image", "image_path": lines[0] + ".png"}]}]}
    page["para_blocks"].append({"type": "image", "index": 5, "blocks": [body]})
    page["discarded_blocks"] = [{"type": "header", "lines": [{"spans": [{"type": "text", "content": "head"}]}]}, {"type": "page_number", "lines": [{"spans": [{"type": "text", "content": "7"}]}]}]
    return json.dumps({"pdf_info": [page]})


def client(role, model, url, key):
    def ask(row):
        with open(key, "a") as f:
            f.write(f"{role} {row['image_path']}\n")
        if role == "screen":
            return json.dumps({"kind": "seal", "rag_value": "low", "detail_level": "skip" if row["image_path"].startswith("s") else "short", "notes": None})
        return json.dumps({"keywords": ["k"], "short_description": "seen " + row["image_path"]})

    return ask


def page_of(markdown):
    return f"<body>{markdown}</body>"


def test_convert_command(spark, tmp_path):
    """Files on disk, models asked once, results kept when run again, and caches by folder."""
    (tmp_path / "in").mkdir()
    for name, text in (("a", "alpha\nmore"), ("s", "solo")):
        (tmp_path / "in" / f"{name}.pdf").write_text(text)
    out, calls = tmp_path / "out", tmp_path / "calls"
    me = "tests.test_reports"
    models = ["--with-image-understanding", "--clients", f"{me}:client", "--image-screening-model", "gpt-5-nano", "--image-understanding-model", "gpt-5", "--image-screening-api-key", str(calls), "--image-understanding-api-key", str(calls)]
    args = ["convert", str(tmp_path / "in"), "--outdir", str(out), "--extractor", f"{me}:extract", "--html-converter", f"{me}:page_of", "--resume"]
    assert cli.main(args, spark) == 0
    assert (out / "a" / "text.md").read_text() == "alpha\n\nmore" and "<body>alpha" in (out / "a" / "text.html").read_text()
    first = json.loads((out / "a" / "middle.json").read_text())
    assert first["source_path"] == str(tmp_path / "in" / "a.pdf") and first["parameters"]["with_image_understanding"] is False and first["extracted_by"] == "pipeline"
    assert cli.main(args + models, spark) == 0
    want = ["screen alpha.png", "screen solo.png", "understand alpha.png"]
    assert sorted(calls.read_text().split("\n")[:-1]) == want
    made = json.loads((out / "a" / "middle.json").read_text())
    kinds = [b["type"] for b in made["middle"]["pdf_info"][0]["para_blocks"]]
    assert kinds.count("header") == 1 and "page_number" not in kinds and made["middle"]["_header_text_first_page"] == {"head": 0}
    assert "description: seen alpha.png" in (out / "a" / "text.md").read_text() and "seen" not in (out / "s" / "text.md").read_text()
    assert made["parameters"]["image_understanding_model"] == "gpt-5" and str(calls) not in (out / "a" / "middle.json").read_text()
    cached = {n: (out / n / "image_understanding_cache.jsonl").read_text().strip().split("\n") for n in "as"}
    assert [len(v) for v in cached.values()] == [1, 1] and json.loads(cached["a"][0])[0]["model"] == "gpt-5-nano"
    # nothing has changed: neither extraction nor models run; a lost result takes its answers from the cache
    before = (out / "a" / "text.md").read_text()
    assert cli.main(args + models, spark) == 0 and sorted(calls.read_text().split("\n")[:-1]) == want
    assert (out / "a" / "text.md").read_text() == before
    (out / "a" / "middle.json").unlink()
    assert cli.main(args + models, spark) == 0 and sorted(calls.read_text().split("\n")[:-1]) == want
    assert (out / "a" / "text.md").read_text() == before


def test_report_html_lists():
    got = reports.report_html("# a\n- x\n- y\n1. z\n![c](p.svg)\ntext\n")
    assert "<ul>\n<li>x</li>\n<li>y</li>\n</ul>\n<ol>\n<li>z</li>\n</ol>" in got and '<img src="p.svg"' in got and "<p>text</p>" in got
    assert reports.dollars(0.001) == "$0.0010" and reports.dollars(0.5) == "$0.500" and reports.percent(None) == "-"
