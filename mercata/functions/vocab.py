"""Word lists, thresholds and templates the results depend on.

Fixed values: results are only right when these equal the published ones.
"""

# --- shop domain (fixed values) ---------------------------------------------
CATEGORIES = ["pharmacy", "grocery", "hardware", "electronics", "stationery"]
CATEGORY_PREFIX = {
    "pharmacy": "PHA",
    "grocery": "GRO",
    "hardware": "HRD",
    "electronics": "ELE",
    "stationery": "STA",
}
# OSM (key, value) selectors of every category.
CATEGORY_TAGS = {
    "pharmacy": [("amenity", "pharmacy"), ("shop", "chemist")],
    "grocery": [("shop", "supermarket"), ("shop", "convenience"),
                ("shop", "greengrocer"), ("shop", "grocery")],
    "hardware": [("shop", "hardware"), ("shop", "doityourself")],
    "electronics": [("shop", "electronics"), ("shop", "mobile_phone"),
                    ("shop", "computer")],
    "stationery": [("shop", "stationery"), ("shop", "copyshop")],
}
# External product category -> category, used for the SKU catalog ...
CATALOG_CATEGORY = {
    "groceries": "grocery",
    "beauty": "pharmacy", "skin-care": "pharmacy", "fragrances": "pharmacy",
    "smartphones": "electronics", "laptops": "electronics",
    "tablets": "electronics", "mobile-accessories": "electronics",
    "furniture": "hardware", "home-decoration": "hardware",
    "kitchen-accessories": "hardware", "lighting": "hardware",
    "sports-accessories": "hardware", "motorcycle": "hardware",
    "vehicle": "hardware",
}
# ... and for the product pool, where the mapping differs.
POOL_CATEGORY = {
    "groceries": "grocery",
    "kitchen-accessories": "hardware", "home-decoration": "hardware",
    "furniture": "hardware",
    "smartphones": "electronics", "mobile-accessories": "electronics",
    "laptops": "electronics", "tablets": "electronics",
    "mens-watches": "electronics", "womens-watches": "electronics",
    "beauty": "pharmacy", "fragrances": "pharmacy", "skin-care": "pharmacy",
}
VARIANTS = [("pack 2 unidades", 1.9), ("formato ahorro", 1.45),
            ("tamaño viaje", 0.6), ("edición premium", 1.8)]
MIN_POOL_PER_CATEGORY = 70
BLURBS = {
    "pharmacy": "Producto de parafarmacia de venta libre. Consulta a tu farmacéutico de confianza.",
    "grocery": "Producto fresco de alimentación, reposición diaria en tienda de barrio.",
    "hardware": "Artículo de ferretería y hogar, calidad profesional para el día a día.",
    "electronics": "Electrónica de consumo con garantía. Pruébalo en tienda antes de llevártelo.",
    "stationery": "Material de papelería para oficina, escuela y dibujo.",
}
BARRIOS = [
    "Malasaña", "Lavapiés", "Salamanca", "Chueca", "La Latina", "Retiro",
    "Moncloa", "Chamberí", "Argüelles", "Embajadores", "Sol", "Las Letras",
    "Chamartín", "Tetuán", "Usera", "Carabanchel", "Puente de Vallecas",
    "Prosperidad", "Arganzuela", "Legazpi", "Cuatro Caminos", "Guindalera",
    "Pacífico", "Conde Duque",
]

# --- geography (fixed values) -------------------------------------------------
EARTH_RADIUS_KM = 6371.0
DEFAULT_CENTRE = (40.4168, -3.7038)
LAT_BOUNDS = (40.2, 40.7)
LNG_BOUNDS = (-4.0, -3.4)
SEARCH_RADIUS_KM = 2.0
REGION_CAP_KM = 1.2

# --- query parsing (fixed values) ---------------------------------------------
SYNONYMS = {
    "dolor de cabeza": ["analgésico", "paracetamol", "ibuprofeno"],
    "headache": ["painkiller", "paracetamol", "ibuprofen"],
    "dolor": ["analgésico"],
    "pain": ["painkiller"],
    "fiebre": ["paracetamol"],
    "fever": ["paracetamol"],
    "tos": ["jarabe"],
    "cough": ["cough syrup"],
    "pilas": ["batteries"],
    "batteries": ["pilas"],
    "usb c": ["charger"],
    "leche": ["milk"],
    "pan": ["bread"],
}
CATEGORY_WORDS = {
    "pharmacy": [
        "paracetamol", "ibuprofeno", "ibuprofen", "analgésico", "painkiller",
        "fiebre", "fever", "tos", "cough", "jarabe", "vitamina", "vitamin",
        "tirita", "bandage",
    ],
    "grocery": [
        "leche", "milk", "pan", "bread", "huevos", "eggs", "arroz", "rice",
        "aceite", "oil", "azúcar", "sugar", "café", "coffee",
    ],
    "hardware": [
        "destornillador", "screwdriver", "martillo", "hammer", "tornillos",
        "screws", "bombilla", "bulb", "pilas", "batteries", "cinta", "tape",
        "llave", "wrench", "guantes", "gloves", "sellador", "silicone",
    ],
    "electronics": [
        "cargador", "charger", "cable", "usb", "usb c", "auriculares",
        "headphones", "ratón", "mouse", "power bank", "hdmi", "microsd",
        "altavoz", "speaker", "hub", "pilas", "batteries",
    ],
    "stationery": [
        "bolígrafo", "pen", "cuaderno", "notebook", "papel", "paper",
        "rotulador", "marker", "grapadora", "stapler", "pegamento", "glue",
        "tijeras", "scissors", "lápices", "pencils",
    ],
}
QUERY_STOPWORDS = [
    "algo", "para", "el", "la", "los", "las", "un", "una", "unos", "unas",
    "de", "del", "al", "en", "con", "y", "o", "que", "qué", "hay", "por",
    "como", "más", "necesito",
    "a", "an", "the", "for", "some", "i", "need", "want", "to", "buy",
    "get", "me", "of", "my", "and", "or", "with", "in", "near", "plus",
    "any", "something",
]
# Place name after "en"/"in": capitalised words, Latin-1 letters.
PLACE_PATTERN = (r"(?<![\p{L}\p{N}_])(?:en|in)[\s\p{Z}]+"
                 r"([A-ZÀ-Ý][\p{L}\p{N}_À-ÿ]*(?:[\s\p{Z}]+[A-ZÀ-Ý][\p{L}\p{N}_À-ÿ]*)*)")

# --- demand signals (fixed values) ----------------------------------------------
DIRECTION_PCT = 15.0
HIGH_WEEKS, HIGH_INTEREST = 8, 20.0
MEDIUM_WEEKS, MEDIUM_INTEREST = 4, 10.0
STABLE_WEEKS = 3
DISCOVERY_TOP_N = 10
DISCOVERY_MIN_INTEREST = 1.0
KEYWORDS_PER_BATCH = 4
TOP_MOVERS = 20
STOCK_OUT_QTY = 2
SIGNAL_NAMESPACE = "4ee47505-4a32-5e02-bc8a-d6fb147fa272"
RISING_NAMESPACE = "6f1c9b02-6b1d-5a4e-9d4b-2f0f2c9a7e31"
CAVEAT = "Basado en interés de búsqueda en Madrid, no en compras reales."
HEADLINES = {
    "rising": "Sube el interés por %s en Madrid",
    "falling": "Baja el interés por %s en Madrid",
    "flat": "Interés estable por %s en Madrid",
}
RECOMMENDATION_BODY = "Tienes %d productos de esta categoría en stock."
CONFIDENCE_ORDER = ["low", "medium", "high"]
# A growth label is a number only when it reads as a percentage.
GROWTH_PATTERN = "(?U)^[+-]?[\\d.,\\s\u00a0\u202f]*\\d[\\d.,\\s\u00a0\u202f]*%$"

# --- relevance of discovered queries (fixed values) -------------------------------
RETAIL_WORDS = ["comprar", "precio", "barato", "oferta", "rebajas", "tienda",
                "online"]
CHAIN_NAMES = ["mercadona", "carrefour", "lidl", "aldi", "druni", "alcampo"]
VARIANT_WORDS = ["led", "g9", "e14", "h7", "hombre", "mujer", "infantil",
                 "nino", "nina", "talla", "pack", "kg", "litro", "ml", "cm"]
NAVIGATIONAL = ["bancos", "empleos", "parques", "museos", "mapas", "vuelos",
                "hoteles", "hospitales", "libros", "juegos", "playa",
                "peliculas"]
BLOCKLIST = NAVIGATIONAL + CHAIN_NAMES + ["amazon"]
INFO_MARKERS = ["que es", "como se", "donde tirar", "donde se tiran",
                "en ingles", "significado", "letra", "receta", "se puede"]
INFO_HEADS = ["que", "como", "cuando", "cuanto", "cuantos", "cuantas",
              "donde", "quien", "quienes", "cual", "cuales", "puedo",
              "por", "para"]
CLUSTER_STOPWORDS = ["de", "la", "el", "para", "con", "en", "los", "las",
                     "del", "al", "y", "se", "un", "una", "unos", "unas",
                     "que", "o", "mi", "su", "tu", "por", "es", "son", "lo"]
CLUSTER_DECORATION = RETAIL_WORDS + CHAIN_NAMES + ["donde"]
MIN_TOKENS, MAX_TOKENS = 2, 5
POINTS = {"contiguous": 2.0, "scattered": 1.0, "retail": 2.0, "variant": 1.0,
          "length": 1.0, "blocklist": -4.0, "informational": -3.0,
          "bare": -2.0}
COMMERCIAL_AT, NOISE_AT = 1.0, 0.0

# --- product search and chat (fixed values) -----------------------------------------
SEARCH_CANDIDATES, SEARCH_RESULTS = 40, 20
NAME_BOOST, TOKEN_BOOST, BRAND_BOOST, STOCK_BOOST = 0.30, 0.15, 0.10, 0.05
PICKS_LIMIT = 12
CHAT_TURNS, CHAT_SUGGESTIONS, DIGEST_LINES = 20, 3, 120
