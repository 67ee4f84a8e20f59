"""The raw tables of a landing folder, each read in the form it is delivered in."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from cellarbook.site import Site
from cellarbook.sources import readers, schemas

# Tables that are no plain sheets.
INVOICES = "izi_facturas"
JSON_TABLES = {"izi_items_inventario": schemas.ITEM_MASTER, "izi_movimientos": schemas.MOVEMENTS}
JUNK_ROWS = {"relacion_copa_vino": 1, "arqueos_{b}": 1}
ESTIMATED = "gastos_aproximados"


class Landing(Mapping[str, DataFrame]):
    """Tables by name, made on demand: `<folder>/<table>.json` or `<folder>/<table>.csv`, a file or a folder of files.

    Sheets are read as text with the columns of their header. `lines` says that JSON files hold a record per
    line. Records that do not parse are kept (`readers.CORRUPT`), so that checks can count them.
    """

    def __init__(self, spark: SparkSession, folder: str, site: Site, tables: tuple[str, ...] = (), lines: bool = False):
        self._spark, self._folder, self._site = spark, folder.rstrip("/"), site
        self._tables, self._lines = tables, lines
        self._made: dict[str, DataFrame] = {}

    def _read(self, name: str) -> DataFrame:
        sheet = f"{self._folder}/{name}.csv"
        if name == INVOICES:
            return readers.read_invoices(self._spark, [f"{self._folder}/{name}.json"], self._site, lines=self._lines)
        if name in JSON_TABLES:
            return readers.read_json_array(self._spark, f"{self._folder}/{name}.json", JSON_TABLES[name], lines=self._lines)
        if name == ESTIMATED:
            columns = list(schemas.ESTIMATES)
            return readers.read_first_block(self._spark, sheet, columns, "Fecha", "Gastos Aproximados")
        skip = next((n for t, n in JUNK_ROWS.items() if t.format(a=self._site.a, b=self._site.b) == name), 0)
        return readers.read_csv(self._spark, sheet, skip=skip)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._read(name)
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)
