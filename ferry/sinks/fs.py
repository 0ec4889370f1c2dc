"""File-system calls through Hadoop's FileSystem API.

Spark writes through Hadoop's FileSystem, so renames, deletes and listings go
through the same client (local, HDFS, ``gs://``, ``s3a://``) with the same
credentials. Only file *names* pass through the driver here, never data.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class FileInfo:
    path: str
    length: int
    is_dir: bool
    modified: int = 0


class HadoopFS:
    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        # the session's Hadoop view: context settings plus this session's own
        # (e.g. a job's credentials)
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._by_root: dict[str, object] = {}
        self._qualified: dict[str, str] = {}

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self, p: str):
        """FileSystem for a path, looked up once per scheme and authority."""
        root = p.split("/", 3)[:3] if "://" in p else [p.split(":", 1)[0] if ":" in p else ""]
        key = "/".join(root)
        fs = self._by_root.get(key)
        if fs is None:
            fs = self._path(p).getFileSystem(self._conf)
            self._by_root[key] = fs
        return fs

    def move_all(self, moves: list[tuple[str, str]], threads: int = 16) -> None:
        """Rename many files; destinations that exist are replaced. Each
        destination folder is listed once instead of probing every file."""
        if not moves:
            return
        existing: set[str] = set()
        for folder in {dst.rsplit("/", 1)[0] for _, dst in moves}:
            if self.exists(folder):
                existing |= {f.path.rsplit("/", 1)[1] for f in self.list(folder)}
        fs = self._fs(moves[0][1])

        def move(pair):
            src, dst = pair
            d = self._path(dst)
            if dst.rsplit("/", 1)[1] in existing:
                fs.delete(d, False)
            if not fs.rename(self._path(src), d):
                raise OSError(f"rename failed: {src} -> {dst}")

        if len(moves) == 1:
            move(moves[0])
            return
        with ThreadPoolExecutor(max_workers=min(threads, len(moves))) as pool:
            list(pool.map(move, moves))

    def qualify(self, p: str) -> str:
        """The full name of a path; a folder is looked up once for all its files."""
        folder, _, name = p.rpartition("/")
        if not folder.strip("/") or folder.endswith((":", ":/", "/")) or name in ("", ".", "..") \
                or ("://" in folder and folder.count("/") < 3):     # a store's own root
            return self._qualify(p)
        if folder not in self._qualified:
            self._qualified[folder] = self._qualify(folder)
        return f"{self._qualified[folder]}/{name}"

    def _qualify(self, p: str) -> str:
        path = self._path(p)
        return str(path.getFileSystem(self._conf).makeQualified(path).toString())

    def encoded(self, p: str) -> str:
        """The name of a file in ``_metadata.file_path``."""
        path = self._path(p)
        return self.uri_form(str(self._fs(p).makeQualified(path).toUri().toString()))

    def exists(self, p: str) -> bool:
        return bool(self._fs(p).exists(self._path(p)))

    def is_dir(self, p: str) -> bool:
        fs = self._fs(p)
        path = self._path(p)
        return bool(fs.exists(path) and fs.getFileStatus(path).isDirectory())

    def is_file(self, p: str) -> bool:
        fs = self._fs(p)
        path = self._path(p)
        return bool(fs.exists(path) and fs.getFileStatus(path).isFile())

    def delete(self, p: str, recursive: bool = True) -> bool:
        return bool(self._fs(p).delete(self._path(p), recursive))

    def mkdirs(self, p: str) -> bool:
        return bool(self._fs(p).mkdirs(self._path(p)))

    def rename(self, src: str, dst: str) -> None:
        fs = self._fs(src)
        if not fs.rename(self._path(src), self._path(dst)):
            raise OSError(f"rename failed: {src} -> {dst}")

    def list(self, p: str) -> list[FileInfo]:
        out = []
        for st in self._fs(p).listStatus(self._path(p)):
            out.append(FileInfo(str(st.getPath().toString()), int(st.getLen()),
                                bool(st.isDirectory()), int(st.getModificationTime())))
        return out

    def read_text(self, p: str) -> str:
        """A whole (small) text file."""
        stream = self._fs(p).open(self._path(p))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, p: str, text: str) -> None:
        self.write_bytes(p, text.encode())

    def write_bytes(self, p: str, data: bytes) -> None:
        stream = self._fs(p).create(self._path(p), True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def status(self, p: str) -> FileInfo:
        st = self._fs(p).getFileStatus(self._path(p))
        return FileInfo(str(st.getPath().toString()), int(st.getLen()), bool(st.isDirectory()),
                        int(st.getModificationTime()))

    def glob(self, pattern: str) -> list[FileInfo]:
        sts = self._fs(pattern).globStatus(self._path(pattern))
        if sts is None:
            return []
        return [FileInfo(str(st.getPath().toString()), int(st.getLen()),
                         bool(st.isDirectory())) for st in sts]

    def copy_file(self, src: str, dst: str) -> None:
        """Copy one (small) file inside the JVM."""
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(
            self._fs(src), self._path(src), self._fs(dst), self._path(dst), False, self._conf)

    def concat(self, target: str, sources: list[str]) -> None:
        """Append ``sources`` to ``target`` (file systems that support it, e.g. HDFS)."""
        jvm = self._jvm
        arr = jvm.java.lang.reflect.Array.newInstance(jvm.org.apache.hadoop.fs.Path,
                                                      len(sources))
        for i, p in enumerate(sources):
            arr[i] = self._path(p)
        self._fs(target).concat(self._path(target), arr)

    def uri_to_path(self, uri: str) -> str:
        """``_metadata.file_path`` / ``inputFiles()`` form → plain path string."""
        return str(self._jvm.org.apache.hadoop.fs.Path(self._jvm.java.net.URI(uri)).toString())

    def uri_form(self, uri: str) -> str:
        """Normal URI spelling (``file:///x`` → ``file:/x``), as in ``_metadata.file_path``."""
        return "file:/" + uri[len("file:///"):] if uri.startswith("file:///") else uri

    def read_head(self, p: str, nbytes: int = 65536) -> bytes:
        """First ``nbytes`` of a file, decompressed by its suffix.

        zstd is decompressed here (Hadoop's zstd codec needs a native library
        that is often missing); gzip and bzip2 use Hadoop's Java codecs.
        """
        path = self._path(p)
        fs = path.getFileSystem(self._conf)
        if p.lower().endswith(".zst"):
            import zstandard
            raw = fs.open(path)
            try:
                data = bytes(raw.readNBytes(max(4 * nbytes, 1 << 18)))
            finally:
                raw.close()
            return zstandard.ZstdDecompressor().decompressobj().decompress(data)[:nbytes]
        factory = self._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(self._conf)
        codec = factory.getCodec(path)
        raw = fs.open(path)
        stream = codec.createInputStream(raw) if codec is not None else raw
        try:
            # InputStream.readNBytes returns byte[] (bytes in Python) of at most n.
            return bytes(stream.readNBytes(int(nbytes)))
        finally:
            stream.close()
