"""Fixed values and run parameters.

The block marked FIXED VALUES must equal the values of the original workflow for results to
match (catalog, domains, tax rate, key sets, label ids, prompt wording). Everything else in
the library is derived from these by rule.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# FIXED VALUES (must equal the original workflow's; natural order, stated as text)
# ---------------------------------------------------------------------------------------------

# Grocery catalog: (category, item name, base price), in catalog order. The list position is
# the item index used by the weighted draw.
CATALOG = [
    ("Produce", "Apple", "1.50"),
    ("Produce", "Banana", "0.50"),
    ("Produce", "Orange", "1.20"),
    ("Produce", "Broccoli", "2.50"),
    ("Produce", "Carrot", "1.80"),
    ("Produce", "Lettuce", "2.00"),
    ("Dairy", "Milk", "3.50"),
    ("Dairy", "Cheese", "5.00"),
    ("Dairy", "Yogurt", "1.00"),
    ("Dairy", "Butter", "4.00"),
    ("Bakery", "Bread", "2.80"),
    ("Bakery", "Croissant", "1.50"),
    ("Bakery", "Bagel", "1.20"),
    ("Pantry", "Pasta", "1.50"),
    ("Pantry", "Rice", "2.00"),
    ("Pantry", "Canned Soup", "1.80"),
    ("Pantry", "Flour", "3.00"),
    ("Pantry", "Sugar", "2.50"),
    ("Meat/Fish", "Chicken Breast", "8.00"),
    ("Meat/Fish", "Ground Beef", "6.00"),
    ("Meat/Fish", "Salmon Fillet", "12.00"),
    ("Beverages", "Soda Can", "1.00"),
    ("Beverages", "Juice Box", "0.80"),
    ("Beverages", "Water Bottle", "1.20"),
    ("Snacks", "Chips", "3.00"),
    ("Snacks", "Cookies", "2.50"),
    ("Snacks", "Chocolate Bar", "1.50"),
]

STORE_NAMES = ["MegaMart", "SuperGrocery", "Local Foods", "FreshMart"]
STORE_LOCATIONS = ["Downtown", "Uptown", "Suburbia", "Westside"]
TAX_RATE = "0.08"

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Page types; the label id is the list position.
PAGE_TYPES = ["informational", "navigational", "commercial", "transactional"]

# Keys a generated receipt object and each of its lines must carry.
RECEIPT_KEYS = ["receipt_id", "customer_id", "store_name", "store_location",
                "receipt_datetime", "items", "subtotal", "tax", "total_amount"]
ITEM_KEYS = ["item_name", "category", "quantity", "unit_price", "item_total"]

# Prefixes of generated identifiers.
STAT_RECEIPT_PREFIX = "STAT_"
STAT_CUSTOMER_PREFIX = "CUST_S_"

# Separator between page HTML and its summary in the classifier input text.
SUMMARY_SEPARATOR = "\n\nSummary: "

# KS verdict texts and significance level.
KS_ALPHA = 0.05
KS_DIFFER = "Distributions differ significantly"
KS_SIMILAR = "Distributions similar"

# Customer id kind per cohort (privacy section).
ID_KIND = {"Statistical": "Hashed (Statistical)", "LLM": "Placeholder/Generated (LLM)"}

# Receipt prompt wording; <SAMPLE_ITEMS> and <YEAR> are filled per prompt row.
RECEIPT_PROMPT = """
    Generate a single, realistic JSON object representing a weekly grocery store receipt.

    Follow these instructions precisely:
    1.  Output *only* the JSON object, starting with { and ending with }. Do not include any explanation or surrounding text.
    2.  The JSON object must have the following top-level keys:
        * "receipt_id": A unique string (e.g., "LLM_ followed by random characters).
        * "customer_id": A placeholder string like "CUST_L_XYZ".
        * "store_name": Choose one from <STORES>.
        * "store_location": Choose one from <LOCATIONS>.
        * "receipt_datetime": A plausible ISO 8601 timestamp string (e.g., "2025-04-07T15:30:00"). Use a realistic date/time for a grocery shop in <YEAR>.
        * "items": A JSON array of purchased items.
        * "subtotal": The sum of all item_total values (calculated by you, the LLM).
        * "tax": The subtotal multiplied by <TAX_RATE> (calculated by you, the LLM).
        * "total_amount": The sum of subtotal and tax (calculated by you, the LLM).
    3.  Each object in the "items" array must have the following keys:
        * "item_name": A common grocery item name (e.g., <SAMPLE_ITEMS>, Milk, Bread, Eggs, Chicken Breast, Apples, Pasta, Rice, etc.).
        * "category": Assign a plausible category from <CATEGORIES>.
        * "quantity": An integer, usually between 1 and 5.
        * "unit_price": A plausible price (float) for the item (e.g., between 0.50 and 15.00).
        * "item_total": The result of quantity * unit_price (calculated by you, the LLM).
    4.  The receipt should contain between 5 and 25 items in the "items" array.
    5.  Ensure all calculations (item_total, subtotal, tax, total_amount) are mathematically correct based on the generated quantities and prices. Use two decimal places for currency values.

    Example JSON structure (values are illustrative):
    {
      "receipt_id": "LLM_abc123",
      "customer_id": "CUST_L_1A3",
      "store_name": "MegaMart",
      "store_location": "Downtown",
      "receipt_datetime": "2025-04-07T17:45:12",
      "items": [
        {
          "item_name": "Milk",
          "category": "Dairy",
          "quantity": 1,
          "unit_price": 3.55,
          "item_total": 3.55
        },
        {
          "item_name": "Bread",
          "category": "Bakery",
          "quantity": 1,
          "unit_price": 2.80,
          "item_total": 2.80
        }
      ],
      "subtotal": 6.35,
      "tax": 0.51,
      "total_amount": 6.86
    }

    Now, generate a new, valid JSON object for a grocery receipt. Only output the JSON.
    """

# Page prompt wording; <PAGE_TYPE> is filled per row.
PAGE_PROMPT = """
    Generate an HTML page for a <PAGE_TYPE> website. Make it realistic and diverse.
    Include appropriate tags, headings, and content based on the page type.
    For an informational page, include a main question and its answer.
    For a navigational page, include a navigation menu and some basic content.
    For a commercial page, include product information and a call-to-action.
    For a transactional page, include a form or a clear action for the user to take.
    Return the result as a JSON object with two keys: 'html' for the HTML content, and 'summary' for a brief description of the page.
    """

# ---------------------------------------------------------------------------------------------
# Run parameters (the original run's values; every operator takes them as arguments)
# ---------------------------------------------------------------------------------------------

SEED = 42
N_CUSTOMERS = 50
N_WEEKS = 12
N_LLM_RECEIPTS = 50
MAX_ATTEMPTS_PER_RECEIPT = 3
START_DATE = "2025-01-01 00:00:00"
KEEP_PROB = 0.95
ITEMS_MEAN = 15
ITEMS_SD = 5
QTY_MIN, QTY_MAX = 1, 3
PRICE_PPM_MIN, PRICE_PPM_MAX = 950_000, 1_050_000
PREF_MIN, PREF_MAX = 1, 3
PREF_WEIGHT = 3
TOP_ITEMS_FIDELITY = 15
TOP_ITEMS_UTILITY = 10
TOP_CATEGORIES_UTILITY = 5
UNIQUE_RATIO = 0.95
UNIQUE_MIN_DISTINCT = 10
TEST_FRACTION = 0.2
MAX_TOKENS = 512
FIDELITY_FEATURES = ["num_items", "subtotal", "total_amount"]
