"""Fixed values of the rules: what they are compared with must be the same everywhere."""

# Domains that are no news sites (link mining), and their exceptions.
MINED_BLACKLIST = (
    "facebook.com", "fb.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "youtube.com", "tiktok.com", "reddit.com",
    "pinterest.com", "tumblr.com", "weibo.com", "weixin.qq.com", "google.com", "google.co.uk", "baidu.com", "bing.com", "yahoo.com",
    "yandex.com", "duckduckgo.com", "cloudflare.com", "amazonaws.com", "cloud.google.com", "azure.com", "akamai.com", "fastly.com",
    "wikipedia.org", "github.com", "stackoverflow.com", "medium.com", "substack.com", "doubleclick.net", "googlesyndication.com",
    "googleadservices.com", "facebook.net", "analytics.google.com", "imgur.com", "flickr.com", "unsplash.com", "pexels.com",
    "wordpress.com", "blogspot.com", "wix.com", "squarespace.com",
)
KNOWN_SITES = (
    "autoblog.com", "motor1.com", "caranddriver.com", "motortrend.com", "edmunds.com", "jalopnik.com", "thetruthaboutcars.com",
    "autoweek.com", "topgear.com", "autoexpress.co.uk", "carwow.co.uk",
)

# Domains whose links on a page are dropped.
PAGE_BLACKLIST = (
    "facebook.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "pinterest.com", "tiktok.com", "reddit.com", "youtube.com",
    "youtu.be", "t.me", "telegram.org", "google.com", "bing.com", "yahoo.com", "baidu.com", "doubleclick.net", "googlesyndication.com",
    "googleadservices.com", "amazon.com", "amzn.to", "cloudflare.com", "jsdelivr.net", "cdnjs.com", "gravatar.com", "wp.com",
    "apps.apple.com", "play.google.com",
)

# Substrings of links that lead to no news, and of paths that hold no articles.
NO_NEWS_LINK = (
    "javascript:", "mailto:", "tel:", "#", "/login", "/signup", "/register", "/account", "/cart", "/checkout", "/payment", "/privacy",
    "/terms", "/about", "/contact", "/search?", "/tag/", "/category/",
)
NO_ARTICLE_PATH = (
    "/category/", "/tag/", "/page/", "/author/", "/about", "/contact", "/privacy", "/terms", "/login", "/signup", "/register",
    "/account", "/search", "/archive", "/sitemap",
)

# Words of a link that speak for the topic.
TOPIC_IN_URL = (
    "auto", "car", "motor", "vehicle", "ev", "electric", "automobile", "automotive", "otomotif", "voiture", "carro", "coche", "wagen",
    "kuruma", "xe", "mobil", "news", "review", "drive", "speed", "racing", "f1", "formula", "tesla", "byd", "nio", "toyota", "honda",
    "bmw", "mercedes",
)
# Words of a text that speak for the topic.
TOPIC_IN_TEXT = (
    "car", "auto", "vehicle", "motor", "ev", "electric", "toyota", "honda", "bmw", "mercedes", "tesla", "ford", "suv", "sedan", "truck",
    "engine", "driving", "road",
)
# Words of a site's address that speak for the topic.
TOPIC_IN_SITE = (
    "auto", "car", "motor", "vehicle", "ev", "electric", "automobile", "automotive", "otomotif", "voiture", "carro", "coche", "wagen",
    "racing", "f1", "formula", "drive", "speed", "turbo", "engine", "wheel", "tire",
)

# Ends of paths that are no articles.
NO_NEWS_PATH = (
    "/privacy", "/privacy-policy", "/privacypolicy", "/terms", "/terms-of-service", "/terms-and-conditions", "/tos", "/legal",
    "/disclaimer", "/about", "/about-us", "/about.html", "/contact", "/contact-us", "/contact.html", "/team", "/staff", "/editorial",
    "/login", "/signin", "/sign-in", "/register", "/signup", "/sign-up", "/account", "/profile", "/settings", "/dashboard",
    "/subscribe", "/subscription", "/membership", "/faq", "/help", "/support", "/sitemap", "/sitemap.xml", "/advertise",
    "/advertising", "/partners", "/careers", "/jobs", "/newsletter", "/newsletters", "/podcast", "/podcasts", "/video", "/videos",
    "/live", "/live-tv", "/shop", "/store", "/cart", "/checkout",
)
# Phrases of titles that are no articles, and words of menus.
NO_NEWS_TITLE = (
    "privacy policy", "privacy notice", "terms of service", "terms and conditions", "about us", "about the company", "contact us",
    "contact information", "cookie policy", "cookie notice", "disclaimer", "subscribe", "subscription", "newsletter signup", "sign in",
    "sign up", "log in", "register", "advertisement", "advertise with us", "sponsored", "editorial policy", "corrections", "fact-checking",
)
MENU_WORDS = ("home", "news", "sports", "entertainment", "business", "technology")

# Time zones of countries.
ZONES = {
    "CN": "Asia/Shanghai", "JP": "Asia/Tokyo", "KR": "Asia/Seoul", "IN": "Asia/Kolkata", "TH": "Asia/Bangkok", "VN": "Asia/Ho_Chi_Minh",
    "ID": "Asia/Jakarta", "MY": "Asia/Kuala_Lumpur", "PH": "Asia/Manila", "SG": "Asia/Singapore", "TW": "Asia/Taipei",
    "HK": "Asia/Hong_Kong", "GB": "Europe/London", "DE": "Europe/Berlin", "FR": "Europe/Paris", "IT": "Europe/Rome",
    "ES": "Europe/Madrid", "NL": "Europe/Amsterdam", "SE": "Europe/Stockholm", "RU": "Europe/Moscow", "US": "America/New_York",
    "CA": "America/Toronto", "BR": "America/Sao_Paulo", "MX": "America/Mexico_City", "AR": "America/Buenos_Aires",
    "AU": "Australia/Sydney", "NZ": "Pacific/Auckland", "AE": "Asia/Dubai", "SA": "Asia/Riyadh", "IL": "Asia/Jerusalem",
    "TR": "Europe/Istanbul",
}

# Fixed values, in order: the first that matches decides. Ends of domains and parts of paths for the country.
COUNTRY_BY_SUFFIX = {
    "com": "US", "net": "US", "org": "US", "io": "US", "cn": "CN", "jp": "JP", "kr": "KR", "de": "DE", "fr": "FR", "uk": "GB",
    "co.uk": "GB", "it": "IT", "es": "ES", "nl": "NL", "br": "BR", "mx": "MX", "ar": "AR", "cl": "CL", "co": "CO", "ru": "RU",
    "pl": "PL", "se": "SE", "no": "NO", "dk": "DK", "fi": "FI", "th": "TH", "vn": "VN", "id": "ID", "my": "MY", "sg": "SG", "ph": "PH",
    "in": "IN", "au": "AU", "nz": "NZ", "ca": "CA", "hk": "HK", "tw": "TW", "pk": "PK", "ae": "AE", "sa": "SA", "tr": "TR", "il": "IL",
    "eg": "EG", "za": "ZA", "ng": "NG", "ke": "KE", "ua": "UA", "cz": "CZ", "at": "AT", "ch": "CH", "be": "BE", "pt": "PT", "ro": "RO",
    "hu": "HU",
}
COUNTRY_BY_PATH = {
    "hk": "HK", "tw": "TW", "cn": "CN", "jp": "JP", "kr": "KR", "de": "DE", "fr": "FR", "es": "ES", "it": "IT", "br": "BR", "mx": "MX",
    "in": "IN", "au": "AU", "uk": "GB", "ru": "RU", "th": "TH", "vn": "VN", "id": "ID", "my": "MY", "ph": "PH",
}
# Fixed values, in order: parts of addresses, then of paths, for the language.
LANGUAGE_BY_PART = {
    "cn": "zh", "tw": "zh", "hongkong": "zh", "jp": "ja", "japan": "ja", "kr": "ko", "korea": "ko", "de": "de", "german": "de",
    "fr": "fr", "french": "fr", "es": "es", "spanish": "es", "pt": "pt", "portuguese": "pt", "ru": "ru", "russian": "ru", "it": "it",
    "italian": "it", "th": "th", "thai": "th", "vn": "vn", "vietnam": "vn", "id": "id", "indonesia": "id", "ar": "ar", "arabic": "ar",
    "hi": "hi", "hindi": "hi",
}
LANGUAGE_BY_PATH = ("zh", "ja", "ko", "de", "fr", "es", "pt", "ru", "ar", "hi", "th", "vi")
# Regions of countries.
REGIONS = {
    "Asia": ("CN", "JP", "KR", "IN", "TH", "VN", "ID", "MY", "SG", "PH", "HK", "TW", "PK", "AE", "SA"),
    "Europe": (
        "DE", "FR", "GB", "IT", "ES", "NL", "SE", "NO", "DK", "FI", "PL", "RU", "CZ", "AT", "CH", "BE", "PT", "RO", "HU", "UA", "TR",
    ),
    "North America": ("US", "CA", "MX"),
    "South America": ("BR", "AR", "CL", "CO"),
    "Oceania": ("AU", "NZ"),
    "Africa": ("ZA", "NG", "KE", "EG"),
    "Middle East": ("IL",),
}
