"""Fixed values.

These lists, weights and patterns define the results: a different entry gives
a different answer. They are kept together, in plain text and in their natural
order, so that they can be reviewed in one place.
"""

# Cells that mean "no value", compared after trimming and lower-casing.
MISSING_MARKERS = ["", "n/a", "na", "null", "none", "-", "--", "nan", "undefined", "?"]

# Characters taken off both ends of a cell.
BLANKS = " \t\n\r\f\x0b ﻿"

# Share of non-missing cells needed to give a column a type.
NUMBER_SHARE = 0.9
DATE_SHARE = 0.85
BOOLEAN_SHARE = 0.95

# Business roles in the order that settles equal scores, with the header words
# that hint at each.
ROLE_HINTS = {
    "date": ["date", "invoicedate", "orderdate", "created", "createdat", "timestamp",
             "time", "day", "period", "transactiondate", "purchasedate", "shipdate"],
    "identifier": ["id", "invoiceno", "invoice no", "orderid", "order id", "transactionid",
                   "reference", "ref no", "uuid", "code", "stockcode", "sku"],
    "product": ["product", "item", "description", "sku", "stockcode", "productname",
                "productcategory", "service", "itemname"],
    "customer": ["customer", "client", "buyer", "account", "user", "member", "subscriber",
                 "customerid", "clientid", "email", "contact"],
    "category": ["category", "segment", "type", "class", "group", "department", "tag",
                 "tier", "status"],
    "quantity": ["quantity", "qty", "units", "count", "volume", "stock", "orderqty",
                 "numberof", "no of"],
    "price": ["price", "unitprice", "rate", "cost per unit", "priceperunit", "listprice",
              "unit cost"],
    "cost": ["cost", "expense", "cogs", "costofgoods", "expenditure", "spend"],
    "revenue": ["revenue", "sales", "total amount", "totalamount", "amount", "total",
                "value", "linetotal", "extendedprice", "turnover", "income", "gmv"],
    "percentage": ["percent", "pct", "rate", "margin", "ratio", "discount"],
    "location": ["country", "region", "market", "location", "territory", "city", "state",
                 "postcode", "zip", "address"],
    "employee": ["employee", "staff", "agent", "rep", "salesperson", "manager", "hire"],
    "inventory": ["inventory", "stocklevel", "warehouse", "reorder", "onhand", "stock qty"],
    "duration": ["duration", "tenure", "length", "daysto", "timeto", "lifespan", "age"],
    "status": ["status", "state", "stage", "flag", "active", "churned", "cancelled"],
}

# Roles whose column has to be numeric.
NUMERIC_ROLES = ["quantity", "price", "cost", "revenue", "percentage", "duration", "inventory"]

# Evidence weights and cut-offs for roles.
NAME_EQUAL = 0.55
NAME_CONTAINS = 0.4
TYPE_AGREES = 0.2
TYPE_DISAGREES = -0.5
ROLE_FLOOR = 0.2
ALTERNATIVE_FLOOR = 0.15
REVIEW_BELOW = 0.6

# Value patterns that support a role.
CURRENCY_SIGN = "[£$€]"
PERCENT_SIGN = r"%\s*$"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
ISO_DAY = r"^\d{4}-\d{1,2}-\d{1,2}"
SLASH_DAY = r"^\d{1,2}[/.]\d{1,2}[/.]\d{2,4}$"
POSTCODE = r"(?i)^[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}$"
ITEM_CODE = "^[A-Z0-9]{4,12}$"

# Text shapes of dates written with a month name.
DAY_MONTH_NAME = r"^\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}$"
MONTH_NAME_DAY = r"^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{2,4}$"
# Further shapes that general date parsers accept.
YEAR_SLASH_DAY = r"^\d{4}/\d{1,2}/\d{1,2}"
SLASH_DAY_TIME = r"^\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}"

BOOLEAN_WORD = "(?i)^(true|false|yes|no|y|n)$"
BOOLEAN_WORD_OR_BIT = "(?i)^(true|false|yes|no|y|n|0|1)$"
PADDED_ISO_DAY = r"^\d{4}-\d{2}-\d{2}"
PLAIN_NUMBER = r"^-?\d+(\.\d+)?$"
# A plain number to the very end of the text, and how any number starts: these only spare other patterns.
ONLY_DIGITS = r"^-?\d+(?:\.\d+)?\z"
# A whole number that is written as it would be after reading it.
WHOLE_NUMBER = r"^(?:0|-?[1-9]\d{0,14})\z"
NUMBER_START = r"^[£$€,+\-.0-9]"
# Characters of the longest match of these patterns, with one line end that "$" overlooks.
LONGEST_BOOLEAN = 6
LONGEST_ITEM_CODE = 13
NUMBER_TEXT = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)$"
NUMBER_OR_PERCENT = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)%?$"
LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"

# Imputation limits.
IMPUTE_MISSING_LIMIT = 40
IMPUTE_UNIQUENESS_LIMIT = 0.8
SKEW_LIMIT = 0.5

# Quality weights: completeness, validity, consistency, uniqueness.
QUALITY_WEIGHTS = {"completeness": 0.4, "validity": 0.3, "consistency": 0.2, "uniqueness": 0.1}
DUPLICATE_PENALTY_CAP = 15

# Labels.
WEEKDAYS = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
BANDS = ["Low", "Medium", "High", "Very High"]

# Order in which roles supply the main measure of a series and of a breakdown.
SERIES_MEASURES = ["revenue", "price", "cost", "quantity", "percentage", "inventory", "duration"]
BREAKDOWN_MEASURES = ["revenue", "price", "quantity"]

# Forecast, smoothing and anomaly constants.
HORIZON = 6
SCENARIOS = {"base": 1.0, "optimistic": 1.15, "conservative": 0.85}
BAND_WIDTH = 0.12
HOLT_LEVEL = 0.4
HOLT_TREND = 0.3
Z_LIMIT = 1.8

# Segment rank fractions.
LOWER_TERCILE = 0.33
UPPER_TERCILE = 0.66

# Words that give a table its purpose, tested in this order.
PURPOSE_WORDS = [
    ("inventory", "stock|inventory|warehouse|sku balance"),
    ("customers", "customer|client|account|crm"),
    ("products", "product|catalog|item|sku"),
    ("finance", "expense|cost|finance|ledger|invoice"),
    ("sales", "sale|order|transaction|revenue"),
]

# Roles whose columns may link two tables, and the parts of a link's confidence.
LINK_ROLES = ["identifier", "customer", "product", "date", "location"]
LINK_SAME_NAME = 0.5
LINK_SAME_ROLE = 0.24
LINK_OVERLAP = 0.35
LINK_FLOOR = 0.48
LINK_CONFIRMED = 0.65
LINK_CAP = 0.99

# Header words that find the retail columns, in order of preference.
RETAIL_COLUMNS = {
    "amount": ["unitprice", "price per unit", "priceperunit", "price", "revenue",
               "total amount", "totalamount", "total", "amount", "sales", "value",
               "linetotal", "extendedprice"],
    "quantity": ["quantity", "qty", "units", "orderqty"],
    "date": ["invoicedate", "date", "orderdate", "created", "time", "timestamp"],
    "product": ["description", "product category", "productcategory", "product", "item",
                "name", "stockcode", "sku"],
    "market": ["country", "region", "market", "location", "territory"],
    "customer": ["customerid", "customer id", "customer", "client", "clientid", "userid",
                 "email"],
}
RETAIL_TOTAL_WORDS = ["total", "amount", "revenue", "sales"]
ORDER_VALUE_EDGES = [25, 50, 100, 200]
LIFETIME_VALUE_EDGES = [50, 200, 500, 1000]
