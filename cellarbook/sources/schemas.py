"""Column names and types of the landed inputs.

Sheets are read as text throughout and typed once, in the datasets; JSON comes with its types. A guessed
schema would change with the rows of the day.
"""

from __future__ import annotations

# Names and types as the sources deliver them.
INVOICE_ITEM = "struct<articulo:string,cantidad:double,codigoInventario:string,precioTotal:double>"
INVOICE = (
    "struct<sucursal:bigint,fechaPago:timestamp_ntz,anulada:int,montoTotal:double,"
    f"listaItems:array<{INVOICE_ITEM}>>"
)
INVOICE_DOCUMENT = f"facturas array<{INVOICE}>"
ITEM_MASTER = (
    "codigo string, nombre string, categoria struct<nombre:string>, precioUnitario double, cantidad double"
)
MOVEMENTS = "fecha timestamp_ntz, cantidad double, tipoMovimiento string, codigoInventario string"

ESTIMATES = (
    "Empresa",
    "Fecha",
    "Fijo/Semanal/Otros",
    "Categoria",
    "Categoria FC",
    "Categoria Detalle",
    "Detalle",
    "Bs",
    "Week",
)

