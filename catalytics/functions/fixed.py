"""Fixed values that must equal the original application's for equal results.

They are stated plainly, in their natural order, and used as parameter
defaults everywhere; every operator accepts an override.
"""

# --- fixed values ---------------------------------------------------------

# Missing-value sentinel written by the listing extractor.
SENTINEL = "N/A"

# Text tokens that a pandas CSV read turns into missing values (its default
# NA list), applied at CSV ingest so a Spark read sees the same nulls.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]

# Score weights: rating, sales (log scale), price penalty per 100, discount.
SCORE_WEIGHTS = {"rating": 2.0, "sales": 1.5, "price": 0.5, "discount": 1.0}

# Best-seller badge markers, matched as lower-case substrings.
BADGE_MARKERS = ["le plus vendu", "best seller", "top selling", "choix d'aliexpress", "choice"]

# Attractiveness rule: thresholds and the label cut.
SALES_THRESHOLD_LOW = 500
SALES_THRESHOLD_HIGH = 2000
RATING_THRESHOLD_GOOD = 4.0
RATING_THRESHOLD_EXCELLENT = 4.5
BADGE_POINTS = 2
ATTRACTIVENESS_SCORE_THRESHOLD = 3

# Model: test share, seed, trees.
TEST_SHARE = 0.25
SEED = 42
NUM_TREES = 100

# Query words that never count as search terms.
STOP_WORDS = ["what", "is", "the", "a", "to", "for", "best", "sell", "nowadays", "show", "me",
              "products", "product", "some", "good", "from", "preferably"]

# Columns searched by retrieval, and columns shown in the context table.
SEARCH_COLUMNS = ["title", "tags", "body_html", "product_type", "vendor"]
CONTEXT_COLUMNS = ["title", "vendor", "product_type", "price", "compare_at_price", "available", "tags",
                   "variant_title", "sku"]

# Category phrase rule in a question (case-insensitive).
CATEGORY_PATTERN = r"(?:in|for|category|type)\s+([a-zA-Z\s\-]+)(?:\s|$)"

# Label used for a missing category value, and facet "no filter" value.
UNKNOWN_LABEL = "Inconnu"
ALL_LABEL = "Tous"

# Display: rating mark and the picture shown without an image.
STAR = "\u2b50"
IMAGE_PLACEHOLDER = "https://via.placeholder.com/150?text=Image+N/A"

# Availability labels.
AVAILABLE_LABEL = "Disponible"
UNAVAILABLE_LABEL = "Indisponible"

# Vendor dominance flag threshold, in percent.
DOMINANCE_PERCENT = 40.0

# Marketplace base used to absolutise root-relative links.
MARKETPLACE_BASE = "https://www.aliexpress.com"

# Retrieval: rows per answer; preview rows for the dataset prompt.
RETRIEVE_TOP_N = 5
PREVIEW_ROWS = 20

# Retail detail markers.
DETAIL_ERROR_NAMES = {"joined": "Error processing page", "paren": "Error loading page"}
DETAIL_NO_NAME = "N/A (Name structure not found)"
DETAIL_NO_H1 = "N/A (pageTitle H1 not found)"

# HTML elements without content.
VOID_ELEMENTS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]

# Result pages: id of the container div, the whole class attribute of its cards
# (direct children only), and the elements of a card's fields as (tag, classes).
CARD_CONTAINER = "card-list"
CARD_CLASSES = "hm_bu search-item-card-wrapper-gallery"
CARD_ELEMENTS = {
    "url": ("a", "jr_g"),
    "name": ("h3", "jr_kp"),
    "price": ("div", "jr_kr"),
    "original_price": ("div", "jr_ks"),
    "discount_percentage": ("span", "jr_kt"),
    "rating": ("span", "jr_kf"),
    "sales_info": ("span", "jr_j7"),
    "image_url": ("img", "mm_be"),
}
SALES_LEAD = "+ "
# Badges: a holder and its direct labels, blocks with a titled picture or a caption.
CARD_BADGES = [("div", "jr_ae"), ("span", "jr_ae"), ("div", "jr_k2"), ("img", "ms_mv"), ("span", "ms_mu")]

# Retail detail pages: (tag, classes), or an outer and an inner element.
DETAIL_TITLE = "pageTitle"
DETAIL_NAME_PARTS = [("span", "ProductName-primary"), ("span", "ProductName-alt")]
DETAIL_TAX_LABEL = ("span", "ProductPrice-taxLabel")
DETAIL_PRICE = [("div", "ProductDetails-form__price"), ("div", "ProductPrice")]
DETAIL_PRICE_PARTS = ("ProductPrice-price", "ProductPrice-finalPrice")
DETAIL_RATING = ("div", "bv_avgRating_component_container notranslate")
DETAIL_REVIEWS = [
    [("button", "bv_main_container_row_flex"), ("div", "bv_numReviews_text")],
    [(None, "ProductDetails-header-V2-metadata"), (None, "bv_numReviews_text")],
]
DETAIL_REVIEWS_LABEL = ("span", "bv-rating-label")
REVIEW_WORD = "review"

# Product cards of a retail listing page (both sources) and the link in each;
# links taken from a page at most.
PRODUCT_CARDS = [[("ul", "ProductCardListing-grid"), ("li", "ProductCard")], [("ul", "row"), ("li", "product-container")]]
PRODUCT_LINK = ("a", "ProductCard-link")
MAX_LINKS = 20

# Context messages when retrieval finds nothing.
NO_HIT_WITH_CATEGORY = ("No specific products matching your query for category '{category}' were found in our "
                        "dataset. I can still try to answer generally if appropriate, or you can try a broader query.")
NO_HIT = ("No specific products matching your query were found in our dataset. Please try a broader query or "
          "check your spelling. I can still try to answer generally if appropriate.")
CONTEXT_HEADER = "Here are some products from our dataset that seem relevant to your query:\n\n"

SYSTEM_MESSAGE = """You are an intelligent eCommerce analytics assistant.
Your goal is to help users make informed decisions by analyzing product trends, prices, availability, and other features based on the provided data.
Respond as if you're talking to an eCommerce entrepreneur looking for guidance.

ALWAYS use the provided product data snippets (if any) to answer the user's question.
If the provided data is insufficient or no relevant products are found, clearly state that.
Do NOT make up products or information not present in the provided snippets.
Format output clearly using bullet points or concise paragraphs.
Be helpful and conversational.
If no products are found, still try to be helpful based on the query if possible, but clearly state data limitations.
"""

PROMPT_TEMPLATE = """
Context from product data:
{context}

User Question:
{question}

Based *only* on the provided context above (and not any external knowledge), please answer the user's question.
If the context is empty or does not contain the answer, state that you cannot answer based on the provided information.
Answer:
"""

PREVIEW_TEMPLATE = """
You are an intelligent eCommerce analytics assistant.

You have access to a structured product dataset scraped from AliExpress. Your goal is to help users make informed decisions by analyzing product trends, prices, ratings, and discounts. Use your reasoning and data understanding to generate helpful, concise, and actionable insights.

Respond as if you're talking to an eCommerce entrepreneur looking for guidance.

Dataset Preview:
{preview}

User Question:
{question}

Instructions:
- Use evidence from the dataset to support your insights.
- Mention product names, prices, discounts, and ratings where relevant.
- Recommend only if data supports it (don't hallucinate).
- Format output clearly using bullet points, tables, or markdown when appropriate.

Answer:
"""

GREETING = "Bonjour! Comment puis-je vous aider à analyser vos données produits aujourd'hui?"
