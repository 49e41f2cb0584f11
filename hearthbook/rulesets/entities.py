"""Fixed values for entity extraction, canonical names and entity scores."""

# Extraction patterns.
PHONE = r"(?<!\d)(?:\+?1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.\-]?\d{3}[\s.\-]?\d{4}(?!\d)"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
URL = (
    r"(?i)https?://[^\s<>\"')\]]+|(?:www\.)[^\s<>\"')\]]+|"
    r"[a-zA-Z0-9][\w\-]*\.(?:com|org|net|io|co|app|dev|me|xyz|info|art|design|shop|store|gallery)"
    r"[^\s<>\"')\],]*"
)
HANDLE = r"@([a-zA-Z0-9_.]{3,30})\b"
DATE = (
    r"(?i)(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|"
    r"Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
    r"\s+\d{1,2}(?:,?\s+\d{4})?|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}[\-/]\d{2}[\-/]\d{2}"
)
PRICE = r"\$[\d,]+\.?\d{0,2}(?:K|M|B)?"
ADDRESS = (
    r"(?i)\d{1,5}\s+(?:[NSEW]\.?\s+)?(?:\w+\s+){1,4}"
    r"(?:Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Road|Rd|Lane|Ln|Way|"
    r"Court|Ct|Place|Pl|Circle|Cir|Highway|Hwy|Route|Rte)"
    r"(?:\s*(?:#|Suite|Ste|Apt|Unit)\s*\w+)?"
    r"(?:,\s*[\w\s]+,\s*[A-Z]{2}\s*\d{5}(?:-\d{4})?)?"
)
TICKER = r"\$([A-Z]{2,5})\b"
TODO = (
    r"(?i)(?:need to|have to|must|should|don't forget|remind me|to[- ]?do|buy|call|book|schedule|"
    r"pick up|drop off|sign up|apply|register|cancel|renew|return|send|submit)\s+(.{5,100})"
)
QUOTE = r"(?m)(?:^|\n)\s*[\"](.{30,300})[\"]"
PRODUCT_NAMES = [
    "Salomon", "Nike", "Adidas", "New Balance", "Yeezy", "Jordan", "Puma", "Asics", "Vans", "Converse",
    "Apple", "Samsung", "Google Pixel", "iPhone", "iPad", "MacBook", "AirPods",
    "Ray-Ban", "Oakley", "Gucci", "Louis Vuitton", "Prada", "Balenciaga", "Supreme",
    "Tesla", "Porsche", "BMW", "Mercedes", "Toyota", "Honda", "Ford", "Rivian", "Slate",
    "DJI", "GoPro", "Canon", "Sony", "Nikon", "Fujifilm", "SHERP", "Berkley", "Bavaria",
]
PRODUCT_NAMED, PRODUCT_PRICED = r"\s+[\w\-]+(?:\s+[\w\-]+)?", r"(?<=\n)([A-Z][\w\s\-]{5,40}?)(?=\s+\$\d)"
PRODUCT = r"(?i)(?:" + "|".join(PRODUCT_NAMES) + ")" + PRODUCT_NAMED + "|" + PRODUCT_PRICED
BUSINESS = (
    r"BILLED TO:\s*\n?\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})"
    r"|([A-Z][\w]+(?:\s+[A-Z][\w]+){0,4})\s+(?:Reservation|Restaurant|Studio|Gallery|Hotel|Resort"
    r"|Retreat|Bar|Cafe|Museum|Theater|Theatre)"
    r"|(?:order from|ordered from)\s+([A-Z][\w]+(?:\s+[\w]+){0,3})"
)
BUSINESS_LINE = r"^([A-Z][\w]+(?:\s+[A-Z][\w]+){0,3})\s*(?::|Reservation|\-|$)"
PERSON = (
    r"(?m)Liked by\s+(\w+)|Followed by\s+(\w+)|@(\w{3,20})\s+(?:Follow|Following)"
    r"|BILLED TO:\s*\n?\s*([A-Z][a-z]+\s+[A-Z][a-z]+)"
    r"|^([A-Z][a-z]{2,15}\s+[A-Z][a-z]{2,15})(?:\s|$)"
)
CONTACT_NAME = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})"

# Words that disqualify an extracted value.
URL_NOISE = ["more", "the", "and", "for", "you", "all", "see"]
HANDLE_SKIP = ["gmail", "yahoo", "hotmail", "outlook", "icloud", "com", "org", "net"]
METRIC_WORDS = r"(?:followers?|following|posts?|likes?|views?)"
PRODUCT_NOISE = [
    "follow", "explore", "share", "order summary", "checkout", "afterpay", "item subtotal",
    "view", "close", "message",
]
SERVICE_NOISE = [
    "send", "message", "your", "view", "follow", "order summary", "item subtotal", "billed to",
    "checkout", "close", "total", "choose", "returning", "confirmation", "item", "day pass",
]
SERVICE_LINE_NOISE = ["close", "choose", "item", "total", "order", "view"]
NAME_NOISE = [
    "send", "message", "your", "story", "explore", "follow", "view", "all", "see", "add",
    "share", "home", "shop", "profile", "more", "close", "suggested", "search", "friends",
    "inbox", "order", "item", "total", "day", "art", "gmail.com", "billed", "choose",
    "returning", "checkout", "confirmation",
]
PROVIDER_HANDLES = ["@gmail", "@yahoo", "@icloud"]

# Category words that switch on the category-dependent extractors.
SERVICE_CATEGORY_WORDS = ["receipt", "purchase", "restaurant", "food", "airbnb", "review"]
MESSAGE_CATEGORY_WORDS = ["message", "chat", "whatsapp", "dm", "sms"]
QUOTE_CATEGORY_WORD = "nspir"

# How many values of a kind one text may yield.
KIND_CAPS = {"todos": 10, "quotes": 5, "products": 10, "services": 10, "people": 15}

# The fourteen kinds in rendering order.
KINDS = [
    "phones", "emails", "urls", "handles", "dates_mentioned", "prices", "addresses", "tickers",
    "todos", "quotes", "products", "services", "people", "contacts",
]

# Names that are never people.
PERSON_BLOCKLIST = [
    "report junk", "new messages", "new message", "people you", "following followers",
    "processing fee", "reels friends", "activity share", "open call", "call website",
    "text message", "learn more", "view all", "send message", "add comment", "see all",
    "suggested for you", "post your reply", "posts followers", "photos reviews",
    "reviews photos", "edit select", "instagram suggested", "instagram", "activity facebook",
    "follow", "comment", "share", "reply", "worldwide shipping", "shipping container",
    "message", "following", "read more", "show more", "load more", "swipe up", "tap here",
    "sponsored", "advertisement", "ad", "promoted", "united states", "united kingdom",
    "united economy", "san francisco", "your state", "new york", "los angeles", "mexico city",
    "black rock", "rock city", "palm springs", "the most", "the art", "the great",
    "the future", "the best", "the real", "the first", "the last", "the new", "the old",
]
HANDLE_NOISE = [
    "@gmail.com", "@yahoo.com", "@icloud.com", "@hotmail.com", "@outlook.com", "@mac.com",
]
COMMON_WORDS = [
    "the", "and", "for", "you", "all", "see", "add", "new", "get", "how", "what", "who",
    "this", "that", "just", "your", "with",
]
SERVICE_BLOCKLIST = [
    "approved", "add to cart", "checkout", "close", "view", "item subtotal", "total",
    "subtotal", "payment", "order summary", "confirmation", "choose", "returning", "abandoned",
    "animation", "about", "general", "privacy", "billed to", "shipping", "free shipping",
    "processing",
]
PRODUCT_BLOCKLIST = [
    "a payment of", "amount paid", "all shopping", "adjustments", "almost", "amount",
    "ambulance service", "abbreviated numbers",
]
# Fixed value: a merged name with this prefix is an organisation.
ORG_PREFIX = "_ORG:"

# Categories that raise the relevance part of the entity score.
RELEVANT_CATEGORIES = [
    "Receipts / Purchases", "Airbnb / Reviews", "Food / Restaurants", "Real Estate",
    "Business / Sponsorship", "Art / Design", "Event Festival", "Travel / Flights",
    "Stocks / Crypto / Finance",
]
