import json

import pytest

from tessera.plans import jobs
from tessera.sources import artifacts


def test_chain_from_files_to_analysis(spark, tmp_path, capsys):
    docs = tmp_path / "docs"
    docs.mkdir()
    for name, body in (("a", "# Alpha\n\nThe alpha page tells of apples. It has two sentences."), ("b", "# Beta\n\nThe beta page tells of bananas.\n\n## More\n\nAnd of berries.")):
        (docs / f"{name}.md").write_text(body)
    lines = lambda name, rows: (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows)) and str(tmp_path / name)
    queries = lines("q.jsonl", [{"query_id": "1", "query": "apples"}, {"query_id": "2", "query": "berries"}])
    relevant = lines("r.jsonl", [{"query_id": "1", "source": "t:a.md", "category": "fruit"}, {"query_id": "2", "source": "t:b.md", "category": "fruit"}])
    references = lines("a.jsonl", [{"question_id": "1", "reference": "Deterministic answer"}, {"question_id": "2", "reference": "other"}])
    at = lambda name: str(tmp_path / name)
    run = lambda *a: jobs.main(list(a), spark)
    run("preprocess", "--input", str(docs), "--source", "t", "--output", at("parsed"))
    for s in ("structure", "fixed", "prompt"):
        run("chunk", "--documents", at("parsed"), "--strategy", s, "--output", at(f"chunks-{s}"))
    run("embed", "--chunks", at("chunks-structure"), "--output", at("vectors"))
    run("retrieve", "--vectors", at("vectors"), "--queries", queries, "--output", at("dense"))
    run("lexical", "--chunks", at("chunks-structure"), "--queries", queries, "--output", at("bm25"))
    run("fuse", "--first", at("dense"), "--second", at("bm25"), "--output", at("hybrid"))
    run("evaluate", "--hits", at("bm25"), "--relevance", relevant, "--output", at("metrics"))
    assert "| structure | 2 | 1.0000 |" in capsys.readouterr().out
    run("budget-metrics", "--hits", at("hybrid"), "--relevance", relevant)
    run("answer", "--hits", at("bm25"), "--chunks", at("chunks-structure"), "--queries", queries, "--output", at("answers"))
    assert "complete" in capsys.readouterr().out
    run("evaluate-answers", "--answers", at("answers"), "--references", references, "--output", at("scores"))
    assert "structure" in capsys.readouterr().out
    with pytest.raises(artifacts.StaleArtifactError):
        run("chunk", "--documents", at("parsed"), "--strategy", "structure", "--output", at("chunks-fixed"))
    run("chunk", "--documents", at("parsed"), "--strategy", "structure", "--output", at("chunks-fixed"), "--replace", "true")
    (docs / "c.md").write_text('<docs-code language="ts">\nnever closed')
    run("preprocess", "--input", str(docs), "--source", "t", "--output", at("again"))
    assert "| c.md | unclosed docs-code at line 1 |" in capsys.readouterr().out and artifacts.load(spark, at("again"), "documents").count() == 2
    with pytest.raises(Exception, match="unclosed"):
        run("preprocess", "--input", str(docs), "--source", "t", "--output", at("fast"), "--fail-fast", "true")
    with pytest.raises(SystemExit):
        run("chunk", "--strategy", "fixed")
