"""WARC records and Merkle trees against plain strings and hashlib."""

import hashlib

from trackengine.llm import common, warc

from ..conftest import SMALL


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def sealed(inner: str, lo: int, hi: int) -> str:
    return sha(f"{inner}:{lo}:{hi}".encode())


def plain_trees(files: dict, fanout: int) -> tuple[dict, dict]:
    """Leaf digests by (file, offset), and root digests by file; all trees are as high as the highest one."""
    levels = {f: [(o, o + len(r), sealed(sha(r), o, o + len(r))) for o, r in sorted(rows)] for f, rows in files.items()}
    leaf = {(f, lo): d for f, level in levels.items() for lo, _, d in level}
    while any(len(level) > 1 for level in levels.values()):
        for f, level in levels.items():
            groups = [level[i : i + fanout] for i in range(0, len(level), fanout)]
            levels[f] = [(g[0][0], g[-1][1], sealed(",".join(d for *_, d in g), g[0][0], g[-1][1])) for g in groups]
    return leaf, {f: level[0][2] for f, level in levels.items()}


def test_digests_and_roots_equal_hashlib(spark):
    pages = common.table(spark, SMALL, "pages")
    html = {r.page_id: (r.url, r.html) for r in pages.collect()}
    assert len(html) == pages.count()
    files = {}
    for r in warc.warc_records(pages, 20).collect():
        url, body = html[r.page_id]
        body = (body or "").encode()
        head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{r.page_id}>\r\nWARC-Target-URI: {url or ''}\r\nWARC-Block-Digest: sha256:{sha(body)}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
        assert bytes(r.record) == head.encode() + body + b"\r\n\r\n"
        files.setdefault(r.file, []).append((r.offset, bytes(r.record)))
    leaf, root = plain_trees(files, 4)
    got = warc.fixity_drill(pages, fanout=4, file_records=20).collect()
    assert len(got) == len(leaf) == len(html) and len(root) > 1
    assert all(r.digest == leaf[r.file, r.lo] and r.root == root[r.file] for r in got)
