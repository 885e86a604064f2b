"""A small server for archives, with single byte ranges and CORS, and a page that shows one."""

from __future__ import annotations

import html
import json
import os
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

from tilewright.sources.pmtiles import pmtiles_metadata

_RUNNING: dict[int, ThreadingHTTPServer] = {}


def byte_range(header: str | None, size: int) -> tuple[int, int] | None:
    """First and last byte of a ``Range`` header; None for all. ValueError if it cannot be met."""
    if not header:
        return None
    unit, _, spec = header.partition("=")
    first, dash, last = spec.partition("-")
    if unit.strip() != "bytes" or not dash or "," in spec:
        raise ValueError(header)
    start, end = (size - int(last), size - 1) if not first.strip() else (int(first), int(last) if last.strip() else size - 1)
    start, end = max(0, start), min(end, size - 1)
    if start > end:
        raise ValueError(header)
    return start, end


def _handler(root: Path):
    class Handler(BaseHTTPRequestHandler):
        def _head(self, code: int, size: int, more=()):
            self.send_response(code)
            for k, v in (("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Headers", "Range"), ("Access-Control-Expose-Headers", "Content-Range, Content-Length"), ("Accept-Ranges", "bytes"), ("Content-Length", str(size)), *more):
                self.send_header(k, v)
            self.end_headers()

        def do_OPTIONS(self):
            self._head(204, 0)

        def do_HEAD(self):
            self.do_GET(body=False)

        def do_GET(self, body=True):
            # only files right inside the folder, whatever the path says
            path = root / os.path.basename(self.path.split("?")[0])
            if not path.is_file():
                return self._head(404, 0)
            size = path.stat().st_size
            try:
                part = byte_range(self.headers.get("Range"), size)
            except ValueError:
                return self._head(416, 0, [("Content-Range", f"bytes */{size}")])
            start, end = part or (0, size - 1)
            more = [("Content-Type", "text/html" if path.suffix == ".html" else "application/octet-stream")]
            if part:
                more.append(("Content-Range", f"bytes {start}-{end}/{size}"))
            self._head(206 if part else 200, end - start + 1, more)
            if body:
                with path.open("rb") as f:
                    f.seek(start)
                    left = end - start + 1
                    while left and (block := f.read(min(left, 1 << 16))):
                        self.wfile.write(block)
                        left -= len(block)

        def log_message(self, *_):
            pass

    return Handler


def serve_tiles(folder, port: int = 8080, host: str = "127.0.0.1") -> str:
    """Serve the files of a folder, or of the folder of a file, until ``stop_server``. Port 0 takes a free one."""
    folder = Path(folder)
    root = (folder.parent if folder.is_file() else folder).resolve()
    if not root.is_dir():
        raise FileNotFoundError(str(folder))
    if port in _RUNNING:
        stop_server(port)
    server = ThreadingHTTPServer((host, port), _handler(root))
    port = server.server_address[1]
    threading.Thread(target=server.serve_forever, daemon=True).start()
    _RUNNING[port] = server
    return f"http://{host}:{port}"


def stop_server(port: int | None = None) -> None:
    for p in [port] if port is not None else list(_RUNNING):
        if server := _RUNNING.pop(p, None):
            server.shutdown()
            server.server_close()


PAINT = {"circle": {"circle-radius": 3, "circle-color": None, "circle-opacity": None}, "line": {"line-color": None, "line-opacity": None}, "fill": {"fill-color": None, "fill-opacity": None}}


def view_tiles(path, url: str, layer: str | None = None, layer_type: str | None = None, color: str = "navy", opacity: float = 0.5, promote_id: str | None = None) -> str:
    """A page beside the archive that shows it on a map, and its address. ``url``: of the server. The type follows the geometry if unset."""
    path = Path(path)
    meta = pmtiles_metadata(path)
    shown = next((v for v in meta["vector_layers"] if layer in (None, v["id"])), None)
    if shown is None:
        raise ValueError(f"{path} has no layer {layer!r}")
    kind = layer_type or ("circle" if "Point" in shown.get("geometry_type", "") else "line" if "Line" in shown.get("geometry_type", "") else "fill")
    if kind not in PAINT:
        raise ValueError(f"layer_type must be one of {tuple(PAINT)}")
    paint = {k: opacity if k.endswith("opacity") else color if v is None else v for k, v in PAINT[kind].items()}
    source = {"type": "vector", "url": f"pmtiles://{url}/{path.name}", **({"promoteId": promote_id} if promote_id else {}), **({"encoding": "mlt"} if meta["tile_format"] == "mlt" else {})}
    style = {"version": 8, "sources": {"t": source}, "layers": [{"id": "l", "type": kind, "source": "t", "source-layer": shown["id"], "paint": paint}]}
    page = f"""<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(path.name)}</title>
<link rel="stylesheet" href="https://unpkg.com/maplibre-gl/dist/maplibre-gl.css"><script src="https://unpkg.com/maplibre-gl/dist/maplibre-gl.js"></script><script src="https://unpkg.com/pmtiles/dist/pmtiles.js"></script>
<style>html,body,#m{{margin:0;height:100%}}</style></head><body><div id="m"></div><script>
maplibregl.addProtocol("pmtiles", new pmtiles.Protocol().tile);
new maplibregl.Map({{container: "m", style: {json.dumps(style).replace("<", chr(92) + "u003c")}, bounds: {json.dumps(list(meta["bounds"]))}}});
</script></body></html>"""
    path.with_suffix(".html").write_text(page, encoding="utf-8")
    return f"{url}/{path.with_suffix('.html').name}"
