"""Values that must be equal to the business's own for the results to be right."""

# ---- fixed values -----------------------------------------------------------

# Branch number of a landed invoice -> business unit ("a" or "b").
BRANCH_UNITS = {79344: "a", 81761: "b"}

# Sold through unit A's till but kept out of its stock facts.
UNTRACKED_CODE_A = "AN000046"

# Hours subtracted from the payment time to get the business date.
BUSINESS_DAY_SHIFT_HOURS = 4

# Codes the item master leaves out, besides those starting with i or I.
MASTER_EXCLUDED_CODES = ("0003698", "002628", "15185151", "6666")
MASTER_EXCLUDED_PREFIXES = ("i", "I")

# Delivery orders.
DELIVERED_STATUS = "Entregado"
DELIVERY_CHANNEL = "PedidosYa"

# Delivery item text, applied in this order after lower-casing.
ITEM_TEXT_REPLACEMENTS = (
    ("]", ""),
    (" 600 ml", ""),
    (" 500 ml", ""),
    (" 500ml", ""),
    ("-", " "),
    ("sin azucar", "zero"),
    ("coca cola zero", "coca zero"),
    ("á", "a"),
    ("gaseosa ", ""),
)

CATEGORY_PREFIXES = (("burger", "1. Burgers"), ("cheeseb", "1. Burgers"), ("sando", "2. Sandos"))
CATEGORY_OTHER = "3. Otros"
VEGETARIAN_CATEGORIES = ("1. Burgers", "2. Sandos")
VEGETARIAN_QUANTITIES = (-1, -2, -3)
VEGETARIAN_MARK = "veg"
EXTRA_MEAT_MARK = "carne extra"

# Delivery commission: (comparison with the day, day, fee), the first that holds; the last is for all later days.
COMMISSION_TIERS = (("<", "2024-09-24", 0.18), ("<=", "2024-10-24", 0.22), (None, None, 0.25))

# A delivery item with its quantity in front.
NUMBERED_ITEM = r"^\s*(\d+)\s+(.*)$"

COMMISSION_TAX_FACTOR = 0.87

# Movement kinds.
MOVEMENT_INTERNAL = "interna"
MOVEMENT_COMPLIMENTARY_A = ("interna", "prod-venta")

# Units of stock behind one sold item.
SALES_FACTORS_BY_NAME = (("Chop Cerveza", 0.75), ("Chop Cerveza 2X1", 1.5))
OWN_SALES_FACTORS_BY_CODE = (("OMU00052", 0.5), ("OMU00053", 0.5), ("OMU00071", 0.5), ("OMU00068", 0.0))
OTHER_UNIT_FACTORS_BY_CODE = (("OMU00052", 0.5), ("OMU00053", 0.5))
DELIVERY_FACTORS_BY_NAME = (("Super Smash Burger", 0.5), ("Carne Extra Super Smash Burger", 0.5))

# Sold code -> ingredient, unit B.
INGREDIENT_CODES = {
    "CARNE MOLIDA": (
        "OMU00011", "OMU00010", "OMU00009", "OMU00008", "OMU00058", "OMU00007", "OMU00006", "OMU00049",
        "OMU00005", "OMU00066", "OMU00072", "OMU00061", "OMU00054", "OMU00055", "OMU00064", "ANC00066",
        "OMU00052", "OMU00071", "OMU00065", "OMU00063", "OMU00062", "OMU00082",
    ),
    "PECHUGA DE POLLO": (
        "OMU00031", "OMU00057", "OMU00030", "OMU00029", "OMU00028", "OMU00027", "OMU00026", "OMU00051",
        "OMU00078", "OMU00079", "OMU00085",
    ),
    "PESCA AMAZONICA": (
        "OMU00059",
    ),
    "QUESO": (
        "OMU00068",
    ),
}

# Ingredient, smallest and largest number of portions to hold.
MIN_MAX_PORTIONS = (
    ("Chuleton", 10, 20),
    ("Corazon de pollo", 10, 20),
    ("Cordero", 15, 25),
    ("Hongos", 10, 20),
    ("Keperi", 50, 60),
    ("Llama", 25, 35),
    ("Matambre de cerdo", 20, 30),
    ("Ojo de bife", 60, 70),
    ("Oreja de cerdo", 10, 20),
    ("Ossobuco", 25, 35),
    ("Panza", 20, 30),
    ("Pato", 15, 25),
    ("Pechuga de pollo", 20, 30),
    ("Pescado amazonico", 20, 30),
    ("Trucha", 35, 45),
)

# P&L layout: group, group order, line, subtotal flag, line order.
PNL_LINES = (
    ("Ingresos", 1, "Ingresos", 0, "1.01"),
    ("Compras", 2, "Compras", 0, "1.02"),
    ("Margen Bruto", 3, "Margen Bruto", 1, "1.03"),
    ("Salarios", 4, "Salarios Fijos", 0, "2.01"),
    ("Salarios", 4, "Salarios Semanales", 0, "2.02"),
    ("Salarios", 4, "Salarios Extras", 0, "2.03"),
    ("Salarios", 4, "Salarios Socios", 0, "2.04"),
    ("Costos", 5, "Costos Fijos", 0, "2.05"),
    ("Costos", 5, "Costos Variables", 0, "2.06"),
    ("Gastos Fijos", 6, "Servicios", 0, "2.07"),
    ("Gastos Fijos", 6, "Alquiler", 0, "2.08"),
    ("Gastos Variables", 7, "Gasto", 0, "2.09"),
    ("EBITDA", 8, "EBITDA", 1, "2.10"),
    ("Impuestos", 9, "Impuestos", 0, "3.01"),
    ("Aproximados", 10, "Aproximados", 0, "3.02"),
    ("Resultado", 11, "Resultado", 1, "3.03"),
    ("Inversion", 12, "Inversion", 0, "4.01"),
    ("Resultado Total", 13, "Resultado Total", 1, "4.02"),
)
PNL_INCOME_LINE = "Ingresos"
PNL_LEFT_OUT = "Dividendos"
PNL_ALL_UNITS = "Todos"
PNL_OPTIONAL_LINE = "Salarios Socios"
PNL_LINES_AFTER_OPTIONAL = ("EBITDA", "Resultado", "Resultado Total")
PNL_FIRST_DATE = "2021-01-01"
DINING_ROOM_CURRENT_FROM = "2025-01-01"
ADVISORY_LABELS = ("EXPLORA 1", "EXPLORA 23", "EXPLORA 26")

# Category lists of the stock reports; "VINO BLANCO" occurs with and without a trailing space.
DRINK_CATEGORIES = ("CERVEZA", "GASEOSAS", "AGUAS")
WINE_CATEGORIES = (
    "VINO BLANCO",
    "VINO BLANCO ",
    "VINO TINTO",
    "VINO ROSADO",
    "VINO DULCE",
    "VINO ESPUMANTE",
    "IMPORTADO BLANCO",
    "IMPORTADO CAVA",
    "IMPORTADO ROSADO",
    "IMPORTADO TINTO",
)
NO_CATEGORY = "Sin categoria"
NULL_TEXT = "–"
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
# ---- end of fixed values ----------------------------------------------------
