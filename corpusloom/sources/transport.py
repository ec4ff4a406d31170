"""Ways to get a page: functions of a url and a time limit in seconds that give an Answer, or a list of them, or raise."""

from __future__ import annotations

from typing import NamedTuple


class Answer(NamedTuple):
    status: int
    content_type: str
    body: str


def http(url: str, seconds: float) -> Answer:
    """One GET. An answer of any status is an answer; no answer in time, or none at all, raises."""
    import urllib.error
    import urllib.request

    request = urllib.request.Request(url, headers={"User-Agent": "corpusloom", "Accept": "text/html,*/*"})
    try:
        answer = urllib.request.urlopen(request, timeout=seconds)
    except urllib.error.HTTPError as e:
        answer = e
    with answer:
        charset = answer.headers.get_content_charset() or "utf-8"
        return Answer(answer.status, answer.headers.get("Content-Type") or "text/html", answer.read().decode(charset, "replace"))


class Stored:
    """Answers from a table of Parquet at a path that every task can open; a url that it lacks raises.

    Each task reads the answers to the urls that it is about to ask for, and those only. Meant to go over a site again without
    asking it; a corpus is joined with sources.pages.fetch() instead. Of several answers to a url, each is given with `every`,
    else the last.
    """

    def __init__(self, path: str, url: str = "url", body: str = "html", status: str | None = None, content_type: str | None = None, every: bool = False):
        self.every = every
        self.path, self.columns = path, {"url": url, "body": body} | ({"status": status} if status else {}) | ({"content_type": content_type} if content_type else {})
        self.known: dict[str, list[Answer]] = {}

    def prepare(self, urls: list[str]) -> None:
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSystem

        files, path = FileSystem.from_uri(self.path)
        rows = ds.dataset(path, filesystem=files, format="parquet").to_table(columns={k: ds.field(c) for k, c in self.columns.items()}, filter=ds.field(self.columns["url"]).isin(urls))
        self.known = {}
        for r in rows.to_pylist():
            if r["body"] is not None:
                self.known.setdefault(r["url"], []).append(Answer(r.get("status") or 200, r.get("content_type") or "text/html", r["body"]))

    def __call__(self, url: str, seconds: float) -> Answer | list[Answer]:
        if url not in self.known:
            raise LookupError("no stored answer")
        return self.known[url] if self.every else self.known[url][-1]
