"""The platforms that a name alone leads to."""

# Names and addresses that results depend on.
PLATFORMS = {
    "irctc": "https://www.irctc.co.in/nget/",
    "railway": "https://www.irctc.co.in/nget/",
    "railways": "https://www.irctc.co.in/nget/",
    "makemytrip": "https://www.makemytrip.com",
    "mmt": "https://www.makemytrip.com",
    "goibibo": "https://www.goibibo.com",
    "redbus": "https://www.redbus.in",
    "ixigo": "https://www.ixigo.com",
    "easemytrip": "https://www.easemytrip.com",
    "uber": "https://m.uber.com",
    "ola": "https://www.olacabs.com",
    "digilocker": "https://www.digilocker.gov.in",
    "uidai": "https://myaadhaar.uidai.gov.in",
    "aadhaar": "https://myaadhaar.uidai.gov.in",
    "aadhar": "https://myaadhaar.uidai.gov.in",
    "incometax": "https://www.incometax.gov.in/iec/foportal/",
    "itr": "https://www.incometax.gov.in/iec/foportal/",
    "parivahan": "https://parivahan.gov.in",
    "vahan": "https://parivahan.gov.in",
    "sarathi": "https://parivahan.gov.in",
    "passport": "https://www.passportindia.gov.in",
    "epfo": "https://www.epfindia.gov.in",
    "pf": "https://www.epfindia.gov.in",
    "cowin": "https://www.cowin.gov.in",
    "upsc": "https://upsc.gov.in",
    "indiapost": "https://www.indiapost.gov.in",
    "postoffice": "https://www.indiapost.gov.in",
    "voters": "https://voters.eci.gov.in",
    "nvsp": "https://voters.eci.gov.in",
    "kiet": "https://www.kiet.edu",
    "aktu": "https://aktu.ac.in",
    "leetcode": "https://leetcode.com",
    "geeksforgeeks": "https://www.geeksforgeeks.org",
    "gfg": "https://www.geeksforgeeks.org",
    "hackerrank": "https://www.hackerrank.com",
    "codeforces": "https://codeforces.com",
    "codechef": "https://www.codechef.com",
    "coursera": "https://www.coursera.org",
    "udemy": "https://www.udemy.com",
    "swayam": "https://swayam.gov.in",
    "nptel": "https://nptel.ac.in",
    "stackoverflow": "https://stackoverflow.com",
    "w3schools": "https://www.w3schools.com",
    "arxiv": "https://arxiv.org",
    "zomato": "https://www.zomato.com",
    "swiggy": "https://www.swiggy.com",
    "blinkit": "https://www.blinkit.com",
    "zepto": "https://www.zepto.com",
    "bigbasket": "https://www.bigbasket.com",
    "dominos": "https://pizzaonline.dominos.co.in",
    "mcdonalds": "https://mcdelivery.co.in",
    "bookmyshow": "https://in.bookmyshow.com",
    "bms": "https://in.bookmyshow.com",
    "hotstar": "https://www.hotstar.com",
    "primevideo": "https://www.primevideo.com",
    "jiocinema": "https://www.jiocinema.com",
    "sonyliv": "https://www.sonyliv.com",
    "zee5": "https://www.zee5.com",
    "cricbuzz": "https://www.cricbuzz.com",
    "espn": "https://www.espncricinfo.com",
    "netflix": "https://www.netflix.com",
    "spotify": "https://open.spotify.com",
    "youtube": "https://www.youtube.com",
    "gaana": "https://gaana.com",
    "jiosaavn": "https://www.jiosaavn.com",
    "wynk": "https://wynk.in/music",
    "soundcloud": "https://soundcloud.com",
    "applemusic": "https://music.apple.com",
    "amazon": "https://www.amazon.in",
    "flipkart": "https://www.flipkart.com",
    "myntra": "https://www.myntra.com",
    "meesho": "https://www.meesho.com",
    "nykaa": "https://www.nykaa.com",
    "ajio": "https://www.ajio.com",
    "target": "https://www.target.com",
    "walmart": "https://www.walmart.com",
    "bestbuy": "https://www.bestbuy.com",
    "ebay": "https://www.ebay.com",
    "sbi": "https://www.onlinesbi.sbi",
    "onlinesbi": "https://www.onlinesbi.sbi",
    "hdfc": "https://netbanking.hdfcbank.com",
    "icici": "https://www.icicibank.com",
    "axis": "https://www.axisbank.com",
    "kotak": "https://www.kotak.com",
    "zerodha": "https://kite.zerodha.com",
    "groww": "https://groww.in",
    "paytm": "https://paytm.com",
    "phonepe": "https://www.phonepe.com",
    "google": "https://www.google.com",
    "wikipedia": "https://www.wikipedia.org",
    "github": "https://www.github.com",
    "reddit": "https://www.reddit.com",
    "twitter": "https://x.com",
    "x": "https://x.com",
    "linkedin": "https://www.linkedin.com",
    "instagram": "https://www.instagram.com",
    "insta": "https://www.instagram.com",
    "facebook": "https://www.facebook.com",
    "fb": "https://www.facebook.com",
    "whatsapp": "https://web.whatsapp.com",
    "telegram": "https://web.telegram.org",
    "gmail": "https://mail.google.com",
    "chatgpt": "https://chatgpt.com",
    "openai": "https://chatgpt.com",
    "gemini": "https://gemini.google.com",
    "claude": "https://claude.ai",
    "canva": "https://www.canva.com",
    "notion": "https://www.notion.so",
    "figma": "https://www.figma.com",
    "drive": "https://drive.google.com",
}

#: The order in which names are tried where a goal may hold several: these first, then the others as above.
FIRST = ("spotify", "youtube", "gaana", "jiosaavn", "wynk", "soundcloud", "applemusic", "amazon", "flipkart", "myntra", "meesho", "nykaa", "ajio", "target", "walmart", "bestbuy", "ebay", "google", "wikipedia", "github", "reddit", "netflix", "cricbuzz", "twitter", "x")
ORDER = (*FIRST, *(name for name in PLATFORMS if name not in FIRST))

# Where a search, given the encoded query, and a cart are, and which platforms play.
SEARCHES = {
    "spotify": "https://open.spotify.com/search/",
    "youtube": "https://www.youtube.com/results?search_query=",
    "gaana": "https://gaana.com/search/",
    "jiosaavn": "https://www.jiosaavn.com/search/",
    "soundcloud": "https://soundcloud.com/search?q=",
    "amazon": "https://www.amazon.in/s?k=",
    "flipkart": "https://www.flipkart.com/search?q=",
    "myntra": "https://www.myntra.com/",
    "google": "https://www.google.com/search?q=",
    "wikipedia": "https://en.wikipedia.org/wiki/Special:Search?search=",
    "github": "https://github.com/search?q=",
    "reddit": "https://www.reddit.com/search/?q=",
    "netflix": "https://www.netflix.com/search?q=",
    "leetcode": "https://leetcode.com/problemset/?search=",
    "geeksforgeeks": "https://www.geeksforgeeks.org/search/?q=",
    "gfg": "https://www.geeksforgeeks.org/search/?q=",
    "coursera": "https://www.coursera.org/search?query=",
    "udemy": "https://www.udemy.com/courses/search/?q=",
    "stackoverflow": "https://stackoverflow.com/search?q=",
    "zomato": "https://www.zomato.com/search?q=",
    "swiggy": "https://www.swiggy.com/search?query=",
    "hotstar": "https://www.hotstar.com/in/explore?search_query=",
}
CARTS = {
    "amazon": "https://www.amazon.in/gp/cart/view.html",
    "flipkart": "https://www.flipkart.com/viewcart",
    "myntra": "https://www.myntra.com/checkout/cart",
    "meesho": "https://www.meesho.com/cart",
    "nykaa": "https://www.nykaa.com/sp/checkout/cart",
    "ajio": "https://www.ajio.com/cart",
    "target": "https://www.target.com/cart",
    "walmart": "https://www.walmart.com/cart",
    "bestbuy": "https://www.bestbuy.com/cart",
    "ebay": "https://cart.ebay.com",
    "swiggy": "https://www.swiggy.com/checkout",
    "blinkit": "https://www.blinkit.com/cart",
    "zepto": "https://www.zepto.com/cart",
    "bigbasket": "https://www.bigbasket.com/basket/",
}
PLAYERS = ("spotify", "youtube", "gaana", "jiosaavn", "wynk", "soundcloud", "applemusic", "netflix", "hotstar", "primevideo", "jiocinema", "sonyliv", "zee5")
