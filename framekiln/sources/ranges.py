"""Files that are read by byte ranges, such as shards behind ``http(s)`` URLs."""

from __future__ import annotations

import io
import time
import urllib.error
import urllib.request
from collections.abc import Callable

AHEAD = 1 << 16
TRIES = 4
WAIT = 0.5
TIMEOUT = 60


class RangeFile(io.RawIOBase):
    """A seekable file over ``fetch(begin, end) -> bytes``.

    Small reads fetch ``ahead`` bytes at once, as headers follow each other closely; larger ones fetch what they ask for.
    """

    def __init__(self, fetch: Callable[[int, int], bytes], size: int, ahead: int = AHEAD) -> None:
        self._fetch, self._size, self._ahead = fetch, size, ahead
        self._at, self._begin, self._held = 0, 0, b""

    def size(self) -> int:
        return self._size

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        base = {io.SEEK_SET: 0, io.SEEK_CUR: self._at, io.SEEK_END: self._size}[whence]
        self._at = max(0, base + offset)
        return self._at

    def read(self, size: int | None = -1) -> bytes:
        end = self._size if size is None or size < 0 else min(self._size, self._at + size)
        if self._at >= end:
            return b""
        if not self._begin <= self._at <= end <= self._begin + len(self._held):
            upto = min(self._size, max(end, self._at + self._ahead))
            data = self._fetch(self._at, upto)
            if len(data) != upto - self._at:
                raise OSError(f"{len(data)} bytes instead of {upto - self._at} at {self._at}")
            self._begin, self._held = self._at, data
        found = self._held[self._at - self._begin : end - self._begin]
        self._at = end
        return found

    def readinto(self, buffer) -> int:
        data = self.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


class HttpStore:
    """Range requests on URLs. Errors of the network and of the server (5xx, 429) are tried again.

    ``opener`` is ``urllib.request.urlopen`` or a stand-in. One request of one byte tells size and version, as
    signed URLs often allow GET only.
    """

    def __init__(self, opener: Callable | None = None) -> None:
        self._opener = opener or urllib.request.urlopen

    def _get(self, url: str, begin: int, end: int) -> tuple[bytes, dict]:
        request = urllib.request.Request(url, headers={"Range": f"bytes={begin}-{end - 1}"})
        for left in reversed(range(TRIES)):
            try:
                with self._opener(request, timeout=TIMEOUT) as answer:
                    if answer.status != 206:
                        raise OSError(f"no byte ranges at {url}")
                    return answer.read(), {k.lower(): v for k, v in answer.headers.items()}
            except urllib.error.HTTPError as problem:
                if problem.code == 404:
                    raise FileNotFoundError(url) from problem
                if problem.code < 500 and problem.code != 429 or not left:
                    raise
            except urllib.error.URLError:
                if not left:
                    raise
            time.sleep(WAIT * 2 ** (TRIES - 1 - left))
        raise AssertionError

    def stat(self, url: str) -> tuple[int, str]:
        """(size, version) of a file."""
        _, headers = self._get(url, 0, 1)
        return int(headers["content-range"].rpartition("/")[2]), headers.get("etag") or headers.get("last-modified") or ""

    def open_input_file(self, url: str) -> RangeFile:
        return RangeFile(lambda begin, end: self._get(url, begin, end)[0], self.stat(url)[0])
