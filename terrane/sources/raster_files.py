"""Readers and writers of rasters: ASCII grids with attribute tables, and classic TIFF. A file is decoded in one task, many
files in parallel; cells come out as rows."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import Header, Raster

CELLS = "r int, c int, v double"


def read_ascii_grid(spark: SparkSession, path: str, centre_is_corner: bool = False) -> tuple[Raster, DataFrame | None]:
    """The raster and its `@RAT` table if there is one. Rows are numbered by line, so a grid is read in parallel;
    xllcenter is shifted by half a cell unless centre_is_corner."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.trim(F.regexp_replace("value", "\r$", "")).alias("line")).where("line <> ''")
    top = lines.orderBy("at").limit(8).collect()
    head, body_at = {}, 0
    for r in top:
        k = r["line"].split()
        if not k[0][0].isalpha():
            break
        head[k[0].lower()] = float(k[1])
        body_at = r["at"]
    cs = head["cellsize"]
    shift = 0.0 if centre_is_corner else cs / 2
    header = Header(int(head["ncols"]), int(head["nrows"]), head.get("xllcorner", head.get("xllcenter", 0.0) - shift), head.get("yllcorner", head.get("yllcenter", 0.0) - shift), cs, head.get("nodata_value", -9999.0))
    mark = lines.where("line like '@RAT%'").agg(F.min("at")).first()[0]
    grid = lines.where(F.col("at") > body_at) if mark is None else lines.where((F.col("at") > body_at) & (F.col("at") < mark))
    from ..operators.network import numbered

    rows = numbered(grid, "at", "r", 64)
    v = F.col("t").try_cast("double")
    cells = rows.select(F.col("r").cast("int").alias("r"), F.posexplode(F.split("line", r"\s+")).alias("c", "t"))
    cells = cells.select("r", "c", F.when(~F.isnan(v) & (F.abs(v - header.nodata) >= 1e-9), v).alias("v"))
    if mark is None:
        return Raster(header, cells), None
    table = [r["line"].split(",") for r in lines.where(F.col("at") > mark).orderBy("at").collect()]
    names = [n.strip().lower() if n.strip().lower() == "value" else n.strip() for n in table[0]]
    rat = spark.createDataFrame([tuple(c.strip() for c in row) for row in table[1:] if len(row) >= len(names)], ", ".join(f"`{n}` string" for n in names))
    return Raster(header, cells), rat.withColumn("value", F.col("value").try_cast("double"))


def write_ascii_grid(raster: Raster, path: str, precision: int = 6, rat: DataFrame | None = None) -> None:
    """One line a row, in order; rows are put together where they lie."""
    h = raster.header
    number = F.coalesce(F.format_string(f"%.{precision}f", F.col("v")), F.lit(f"{h.nodata:g}"))
    rows = raster.df.groupBy("r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", number.alias("t")))), lambda x: x["t"]), " ").alias("value")).select(F.col("r").cast("long").alias("k"), "value")
    head = [f"ncols {h.ncols}", f"nrows {h.nrows}", f"xllcorner {h.xll!r}", f"yllcorner {h.yll!r}", f"cellsize {h.cellsize!r}", f"NODATA_value {h.nodata:g}"]
    extra = [(i - len(head), t) for i, t in enumerate(head)]
    if rat is not None:
        extra += [(2**40 + i, t) for i, t in enumerate(["@RAT", ",".join(rat.columns), *[",".join("" if v is None else str(v) for v in r) for r in rat.collect()]])]
    raster.df.sparkSession.createDataFrame(extra, "k long, value string").unionByName(rows).repartitionByRange(1, "k").sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


# TIFF

_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d"}
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8}


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears, 257 ends."""
    out, table, width, bits, count, last = bytearray(), [], 9, 0, 0, b""
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    table = list(fresh)
    for byte in data:
        bits, count = bits << 8 | byte, count + 8
        while count >= width:
            code = bits >> (count - width) & ((1 << width) - 1)
            count -= width
            bits &= (1 << count) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = list(fresh), 9, b""
                continue
            word = table[code] if code < len(table) else last + last[:1]
            if last:
                table.append(last + word[:1])
            out += word
            last = word
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i] if data[i] < 128 else data[i] - 256
        i += 1
        if n >= 0:
            out += data[i : i + n + 1]
            i += n + 1
        elif n != -128:
            out += data[i : i + 1] * (1 - n)
            i += 1
    return bytes(out)


class Tiff:
    """The first image of a classic TIFF: strips or tiles, plain, LZW or PackBits, horizontal predictor, integers or
    floats."""

    def __init__(self, data: bytes):
        self.data, self.o = data, "<" if data[:2] == b"II" else ">"
        magic, at = struct.unpack(self.o + "HI", data[2:8])
        if magic != 42:
            raise ValueError("not a classic TIFF")
        (n,) = struct.unpack(self.o + "H", data[at : at + 2])
        self.tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack(self.o + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
            size = _SIZE.get(kind, 1) * count
            raw = data[at + 10 + 12 * i : at + 14 + 12 * i]
            if size > 4:
                (where,) = struct.unpack(self.o + "I", raw)
                raw = data[where : where + size]
            if kind in _TYPES:
                self.tags[tag] = raw[:count].split(b"\0")[0].decode("latin-1") if kind == 2 else struct.unpack(self.o + _TYPES[kind] * count, raw[:size])
        one = lambda t, d: self.tags.get(t, (d,))[0]
        self.width, self.height, self.bits, self.compression, self.bands = one(256, 0), one(257, 0), one(258, 8), one(259, 1), one(277, 1)
        self.predictor, self.format, self.planar = one(317, 1), one(339, 1), one(284, 1)
        scale, tie = self.tags.get(33550, (1.0, 1.0, 0.0)), self.tags.get(33922, (0.0,) * 6)
        keys = self.tags.get(34735, ())
        point = any(keys[i] == 1025 and keys[i + 3] == 2 for i in range(4, len(keys) - 3, 4))
        half = 0.5 if point else 0.0
        self.cell, self.left, self.top = scale[0], tie[3] - (tie[0] + half) * scale[0], tie[4] + (tie[1] + half) * scale[1]
        try:
            self.nodata = float(self.tags.get(42113, "nan"))
        except (ValueError, TypeError):
            self.nodata = float("nan")

    def header(self) -> Header:
        return Header(self.width, self.height, self.left, self.top - self.height * self.cell, self.cell, -9999.0)

    def blocks(self):
        """(row, column, height, width, offset, size, band or None) of each block."""
        if 324 in self.tags:
            bw, bh, offsets, sizes = self.tags[322][0], self.tags[323][0], self.tags[324], self.tags[325]
        else:
            bw, bh, offsets, sizes = self.width, min(self.tags.get(278, (self.height,))[0], self.height), self.tags[273], self.tags[279]
        across, down = -(-self.width // bw), -(-self.height // bh)
        for i, (o, s) in enumerate(zip(offsets, sizes)):
            band, k = (i // (across * down), i % (across * down)) if self.planar == 2 else (None, i)
            yield k // across * bh, k % across * bw, bh, bw, o, s, band

    def block(self, spec, band: int) -> np.ndarray:
        row, _, bh, bw, offset, size, _ = spec
        raw = self.data[offset : offset + size]
        raw = {1: bytes, 5: _lzw, 32773: _packbits}[self.compression](raw)
        kind = {1: "u", 2: "i", 3: "f"}[self.format] + str(self.bits // 8)
        lanes = 1 if self.planar == 2 else self.bands
        rows = bh if 324 in self.tags else min(bh, self.height - row)
        a = np.frombuffer(raw, np.dtype(self.o + kind), rows * bw * lanes).reshape(rows, bw, lanes)
        if self.predictor == 2:
            a = np.cumsum(a, axis=1, dtype=a.dtype)
        return a[:, :, 0 if self.planar == 2 else band].astype(float)


def read_tiff(spark: SparkSession, path: str, band: int = 1, box: tuple[float, float, float, float] | None = None) -> Raster:
    """One band as cells; with a box only the blocks that it touches are decoded. Blocks are dealt to tasks."""
    data = spark.read.format("binaryFile").load(path).select("content")
    first = Tiff(bytes(data.first()[0]))
    h = first.header()
    c0, c1, r0, r1 = 0, h.ncols - 1, 0, h.nrows - 1
    if box:
        c0, c1 = max(0, int(np.floor((box[0] - h.xll) / h.cellsize))), min(h.ncols - 1, int(np.ceil((box[2] - h.xll) / h.cellsize)) - 1)
        r0, r1 = max(0, int(np.floor((h.ymax - box[3]) / h.cellsize))), min(h.nrows - 1, int(np.ceil((h.ymax - box[1]) / h.cellsize)) - 1)
    wanted = [i for i, b in enumerate(first.blocks()) if b[0] <= r1 and b[0] + b[2] > r0 and b[1] <= c1 and b[1] + b[3] > c0 and b[6] in (None, band - 1)]

    def decode(batches):
        import pyarrow as pa

        for b in batches:
            for content, numbers in zip(b.column(0), b.column(1).to_pylist()):
                t = Tiff(content.as_py())
                specs = list(t.blocks())
                for i in numbers:
                    a = t.block(specs[i], band - 1)
                    rr, cc = np.mgrid[specs[i][0] : specs[i][0] + a.shape[0], specs[i][1] : specs[i][1] + a.shape[1]]
                    keep = (rr >= r0) & (rr <= r1) & (cc >= c0) & (cc <= c1)
                    v = a[keep]
                    bad = np.isnan(v) | (v == t.nodata)
                    yield pa.RecordBatch.from_arrays([pa.array((rr[keep] - r0).astype(np.int32)), pa.array((cc[keep] - c0).astype(np.int32)), pa.array(v, mask=bad)], ["r", "c", "v"])

    tasks = min(len(wanted), 64) or 1
    jobs = spark.createDataFrame([(wanted[i::tasks],) for i in range(tasks)], "numbers array<int>").repartition(tasks)
    head = Header(c1 - c0 + 1, r1 - r0 + 1, h.xll + c0 * h.cellsize, h.ymax - (r1 + 1) * h.cellsize, h.cellsize, h.nodata if h.nodata == h.nodata else -9999.0)
    return Raster(head, data.crossJoin(jobs).mapInArrow(decode, CELLS))


def tiff_bytes(values: np.ndarray, cell: float, left: float, top: float, nodata: float = -9999.0) -> bytes:
    """A plain single-band float TIFF, for export and tests."""
    h, w = values.shape
    body = np.where(np.isnan(values), nodata, values).astype("<f4").tobytes()
    mark = f"{nodata:g}\0".encode()
    entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 32), (259, 3, 1, 1), (277, 3, 1, 1), (278, 4, 1, h), (279, 4, 1, len(body)), (339, 3, 1, 3)]
    extra_at = 8 + 2 + 12 * (len(entries) + 4) + 4
    scale, tie = struct.pack("<3d", cell, cell, 0.0), struct.pack("<6d", 0, 0, 0, left, top, 0)
    entries += [(33550, 12, 3, extra_at), (33922, 12, 6, extra_at + 24), (42113, 2, len(mark), extra_at + 72), (273, 4, 1, extra_at + 72 + len(mark))]
    ifd = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in sorted(entries)) + struct.pack("<I", 0)
    return b"II*\0" + struct.pack("<I", 8) + ifd + scale + tie + mark + body


def rat_rows(raster: Raster) -> DataFrame:
    """S16 export: the distinct values with counts, the start of an attribute table."""
    return raster.df.where("v is not null").groupBy(F.col("v").alias("value")).agg(F.count("*").alias("count"))


def check_rat(columns: Sequence[str]) -> None:
    if "value" not in [c.lower() for c in columns]:
        raise ValueError("an attribute table needs a column `value`")
