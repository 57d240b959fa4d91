"""Fixed values of the document model. They must be as they are for right results."""

DOC_TYPES = ("invoice", "payslip", "id_proof", "bank_statement", "other")

#: Fields with their types, and tables with their columns, by document type.
SCHEMAS = {
    "invoice": {
        "fields": {"vendor_name": "name", "invoice_number": "id_number", "invoice_date": "date", "total_amount": "amount", "tax_amount": "amount", "currency": "text"},
        "tables": {"line_items": ("description", "quantity", "unit_price", "amount")},
    },
    "payslip": {
        "fields": {"employee_name": "name", "employee_id": "id_number", "pay_period": "date", "gross_pay": "amount", "net_pay": "amount"},
        "tables": {"deductions": ("deduction_type", "amount")},
    },
    "id_proof": {
        "fields": {"full_name": "name", "date_of_birth": "date", "id_number": "id_number", "address": "text", "issue_date": "date", "expiry_date": "date"},
        "tables": {},
    },
    "bank_statement": {
        "fields": {"account_holder_name": "name", "account_number": "id_number", "statement_period": "date", "closing_balance": "amount"},
        "tables": {"transactions": ("date", "description", "amount", "balance")},
    },
    "other": {"fields": {}, "tables": {}},
}

#: Default sensitivity by document type; others are low.
SENSITIVITY = {"id_proof": "high", "payslip": "high", "bank_statement": "high", "invoice": "low", "other": "low"}

#: A field is personal if its type is one of these or its name holds one of these.
PERSONAL_TYPES = ("id_number",)
PERSONAL_NAMES = (
    "id_number", "passport", "ssn", "social_security", "license", "tax_id", "pan", "aadhaar", "voter", "account_number", "account_no",
    "iban", "credit_card", "card_number", "dob", "date_of_birth", "birth", "salary", "net_pay", "gross_pay", "basic_salary", "routing_number",
)

#: Editing software; the first that a producer's name holds counts.
EDITING_SOFTWARE = (
    "photoshop", "gimp", "paint", "paint.net", "canva", "illustrator", "inkscape", "coreldraw", "acrobat distiller", "ilovepdf",
    "sejda", "pdfescape", "nitro", "pdf editor", "pixlr",
)

#: Words in a field's name that tell its type, in order of precedence.
NAME_HINTS = (
    ("date", ("date", "dob", "period", "expiry", "issue")),
    ("amount", ("amount", "pay", "balance", "price", "total", "tax", "fee", "cost")),
    ("name", ("name", "holder", "employee", "vendor", "customer")),
    ("id_number", ("number", "id", "num", "code", "account", "ssn", "ein")),
)
AMOUNT_VALUE = r"^\$?\s*-?\d+(?:,\d{3})*(?:\.\d{1,2})?\s*(?:usd|eur|gbp|inr)?$"
DATE_VALUE = r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$"
DATE_LIKE = r"\b(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\b"

#: Start and end fields whose order is checked.
DATE_PAIRS = (("invoice_date", "due_date"), ("issue_date", "expiry_date"), ("statement_period_start", "statement_period_end"), ("start_date", "end_date"))

# Weights and thresholds.
WEIGHT_OCR, WEIGHT_LLM, WEIGHT_RULE = 0.4, 0.4, 0.2
GREEN, AMBER, RULE_CAP = 0.75, 0.40, 0.50
CELL_OCR, CELL_RULE, CELL_UNMAPPED = 0.7, 0.3, 0.8
LOW_WORD_CONFIDENCE, HIGH_WORD_CONFIDENCE = 0.60, 0.80
BLUR_LIMIT, HASH_DISTANCE, SUM_TOLERANCE = 100.0, 5, 1.0
OVERLAP_MARGIN, LINE_MARGIN, LINE_BUCKET, CROP_PADDING = 3, 10, 15, 10
FUZZY_RATIO, PROMPT_CHARS, CONTEXT_ROWS, HISTORY_TURNS = 0.75, 4000, 10, 4
GAP_DAYS, LARGE_GAP_DAYS, CLOCK_SKEW_DAYS = 1.0, 14.0, -0.01
FONT_Z, FONT_Z_MEDIUM, FONT_Z_HIGH, FONT_STD_FLOOR, FONT_LEAST_HEIGHT, FONT_LEAST_WORDS = 2.0, 2.5, 3.5, 2.0, 6, 5
STROKE_SAMPLE, STROKE_MEAN, STROKE_STD, STROKE_STD_FLOOR, STROKE_LEAST = 50, 2.5, 1.0, 0.8, 0.5
SNIPPET_CHARS = 80
RESAVE_QUALITY, RESAVE_LEVEL, RESAVE_PERCENT = 90, 25.0, 1.5
STEP_CORNER, STEP_KNIGHT = 1.4, 2.1969  #: of distances in pictures
LINE_JOIN, LEAST_PART = (30, 2), 300  #: width and height by which letters are joined to lines; pixels of a part that counts
STROKE_LEAST_SIDE, FIELD_LEAST_SIDE = 6, 8
NO_HASH = "0000000000000000"
MASKED = "[masked — verification required]"
