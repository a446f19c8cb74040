"""Words and patterns of product names.  All fixed values: results depend on them."""

from __future__ import annotations

# Misspellings (patterns) and what they stand for.
CORRECTIONS = (
    (r"\bavacado(?:es|s)?\b", "avocado"),
    (r"\btamato(?:es|s)?\b", "tomato"),
    (r"\blentles\b", "lentils"),
    (r"\bcapsicumms?\b", "capsicum"),
    (r"\bslcd\b", "sliced"),
    (r"\b200gram\b", "200 g"),
    (r"\b1kg\b", "1 kg"),
)
# Other names of products.
SYNONYMS = {
    "zucchini": ("courgette", "courgettes"),
    "capsicum": ("bell pepper", "bell peppers"),
    "coriander": ("cilantro",),
    "spring onion": ("green onion", "green onions", "scallion", "scallions"),
    "eggplant": ("aubergine", "aubergines"),
    "chickpea": ("chickpeas", "garbanzo beans", "garbanzo"),
    "beef stock": ("beef broth",),
    "chicken stock": ("chicken broth",),
    "vegetable stock": ("vegetable broth", "veggie stock"),
    "greek yoghurt": (
        "greek natural yoghurt", "natural greek yoghurt", "plain greek yoghurt", "greek yogurt", "greek natural yogurt",
        "natural greek yogurt", "plain greek yogurt", "greek style natural yoghurt", "greek style natural yogurt",
    ),
    "lime juice": ("juice of lime",),
    "lemon juice": ("juice of lemon",),
    "button mushroom": (
        "button mushrooms", "sliced mushroom", "sliced mushrooms", "coles sliced mushroom", "coles sliced mushrooms",
        "coles slcd mushroom", "coles slcd mushrooms",
    ),
}
# Kinds of a product, and other names of these.
VARIANTS = {
    "no added salt": ("no salt added",),
    "reduced salt": ("salt reduced", "low salt", "lower salt"),
    "no added sugar": ("no sugar added",),
    "fat free": ("0% fat", "zero fat", "no fat"),
    "reduced fat": ("low fat", "lite", "light"),
    "gluten free": (),
    "lactose free": (),
    "wholemeal": ("whole wheat",),
    "free range": (),
    "organic": (),
}
# Ways of preparing.
PREPARATIONS = (
    "coarsely chopped", "finely chopped", "roughly chopped", "thinly sliced", "thickly sliced", "chopped", "diced", "sliced", "grated", "shredded",
    "crushed", "drained", "rinsed", "trimmed", "peeled", "seeded", "halved", "quartered", "melted", "softened", "cooked",
)
# Patterns of what a recipe says after the product.
RECIPE_TAILS = (
    r"\btrimmed\s+of\s+woody\s+stalks?\b.*$",
    r"\bcut\s+into\s+(?:(?:\d+(?:\.\d+)?)\s*)?(?:cm|centimetres?)?\s*(?:pieces?|slices?|wedges?|cubes?)\b.*$",
    r"\bmixed\s+with\b.*$",
    r"\bto\s+(?:serve|garnish)\b.*$",
)
# Words that aren't part of a product's core name.
REMOVABLE = (
    "coarsely", "finely", "roughly", "thinly", "thickly", "chopped", "diced", "sliced", "grated", "shredded", "crushed", "drained", "rinsed", "trimmed",
    "peeled", "seeded", "halved", "quartered", "optional", "divided", "melted", "softened", "cooked", "fresh", "frozen", "dried", "skinless", "skin-on",
    "skin", "on", "off", "fillet", "fillets", "portion", "portions",
)
CONTAINERS = ("can", "cans", "tin", "tins", "jar", "jars", "packet", "packets", "pack", "packs", "bottle", "bottles", "bunch", "bunches")
RETAILER_WORDS = ("coles", "woolworths", "aldi", "costco")
MEASURES = ("kg", "g", "mg", "ml", "l", "cup", "cups", "tbsp", "tsp", "x")
# Plurals and their singulars.
SINGULARS = {
    "carrots": "carrot", "lemons": "lemon", "limes": "lime", "onions": "onion", "tomatoes": "tomato", "potatoes": "potato",
    "mushrooms": "mushroom", "capsicums": "capsicum", "avocados": "avocado", "bananas": "banana", "apples": "apple", "pears": "pear",
    "chickpeas": "chickpea", "lentils": "lentil", "beans": "bean", "prawns": "prawn", "fillets": "fillet", "breasts": "breast",
    "pecans": "pecan", "hazelnuts": "hazelnut", "cloves": "clove",
}
SMALL_WORDS = ("and", "of", "or", "the", "with")
FRACTIONS = {"¼": 0.25, "½": 0.5, "¾": 0.75, "⅓": 1 / 3, "⅔": 2 / 3, "⅛": 0.125, "⅜": 0.375, "⅝": 0.625, "⅞": 0.875}

# Words of style sheets, of measures and of sizes.
TECHNICAL = (
    "css", "font", "style", "inherit", "weight", "webkit", "text", "decoration", "display", "flex", "grid", "margin", "padding", "border", "background", "colour",
    "color", "line", "height", "letter", "spacing", "align", "justify", "position",
)
LEADING_MEASURES = ("quantity", "tablespoon", "tablespoons", "teaspoon", "teaspoons", "tbsp", "tsp", "cup", "cups", "gram", "grams", "kilogram", "kilograms", "kg", "g", "ml", "litre", "litres", "spray")
SIZES = ("small", "medium", "large", "mini", "baby", "extra large")
# Patterns of preparation, in the order in which they are taken out, and their names.
PREPARATION_PATTERNS = (
    (r"\bcore\s+removed\b", "Core Removed"),
    (r"\bcored\b", "Cored"),
    (r"\bhusks?\s+and\s+silk\s+removed\b", "Husks And Silk Removed"),
    (r"\bseeds?\s+removed\b", "Seeds Removed"),
    (r"\bstoned\b", "Stone Removed"),
    (r"\bcut\s+into\s+(?:(?:\d+(?:\.\d+)?)\s*)?(?:cm|centimetres?)?\s*thick\s+slices?\b", "Cut Into Thick Slices"),
    (r"\bcut\s+into\s+thin\s+wedges\b", "Cut Into Thin Wedges"),
    (r"\bcut\s+into\s+wedges\b", "Cut Into Wedges"),
    (r"\b(?:horizontally|vertically|lengthways|lengthwise|crosswise)\b", "Cut Direction Removed"),
    (r"\bcut\s+into\s+[^,;]+$", "Cut Into Pieces"),
    (r"\blightly\s+toasted\b", "Lightly Toasted"),
    (r"\bdry[ -]toasted\b", "Dry Toasted"),
    (r"\bfinely\s+diced\b", "Finely Diced"),
    (r"\bfinely\s+chopped\b", "Finely Chopped"),
    (r"\bthinly\s+sliced\b", "Thinly Sliced"),
    (r"\broughly\s+chopped\b", "Roughly Chopped"),
    (r"\b(?:freshly|finely|roughly|thinly|lightly)\b", "Preparation Modifier Removed"),
    (r"\bpeeled\b", "Peeled"),
    (r"\bunpeeled\b", "Unpeeled"),
    (r"\btoasted\b", "Toasted"),
    (r"\broasted\b", "Roasted"),
    (r"\bchopped\b", "Chopped"),
    (r"\bdiced\b", "Diced"),
    (r"\bsliced\b", "Sliced"),
    (r"\bgrated\b", "Grated"),
    (r"\bcrumbled\b", "Crumbled"),
    (r"\bthawed\b", "Thawed"),
    (r"\btorn\b", "Torn"),
    (r"\binto\s+(?:\d+(?:\.\d+)?\s*)?cm\s+cubes?\b", "Cut Into Cubes"),
    (r"\bcrushed\b", "Crushed"),
    (r"\bdrained\b", "Drained"),
    (r"\brinsed\b", "Rinsed"),
    (r"\bsoftened\b", "Softened"),
    (r"\bmelted\b", "Melted"),
    (r"\btrimmed\b", "Trimmed"),
    (r"\bends?\b", "Ends Removed"),
    (r"\bhalved\b", "Halved"),
    (r"\bquartered\b", "Quartered"),
)
# Patterns of recipe talk in a name, taken out in this order.
RECIPE_TALK = (
    (r"(?i)\b([a-z]+)\s+or\s+[a-z]+\s+([a-z]+)\b", "$1 $2"),
    (r"(?i)^cm\s+pieces?\s*", ""),
    (r"(?i)^(?:extra\s+)?pinch\s+(?:of\s+)?", ""),
    (r"(?i)^firmly\s+packed\s+", ""),
    (r"(?i)^or\s+", ""),
    (r"(?i)^sized\s+", ""),
    (r"(?i)^store\s+bought\s+", ""),
    (r"^quantity\s+of\s+", ""),
    (r"(?i)\binto\s+thin\s+ribbons?\s+with\s+(?:a\s+)?vegetable\s+peeler\b.*$", ""),
    (r"(?i)\bwhite\s+part\s+only\b.*$", ""),
    (r"(?i)\bapproximately\s+per\s+tortilla\b.*$", ""),
    (r"\bto\s+serve\b.*$", ""),
    (r"\bfor\s+garnish\b.*$", ""),
    (r"\bto\s+garnish\b.*$", ""),
    (r"\bplus\s+(?:teaspoons?\s+)?extra\b.*$", ""),
    (r"\bto\s+taste\b.*$", ""),
)
LEADING_VARIANTS = ("extra virgin", "wholemeal", "multigrain", "sourdough", "basmati", "jasmine", "brown", "white", "skim", "full cream", "extra lean", "lean", "organic", "green", "red")
# Families by pattern; the first that fits counts.
FAMILIES = (
    (r"\bflatbreads?\b|\bdippers?\b", "Flatbread Dippers"),
    (r"\bcrackers?\b", "Crackers"),
    (r"\b(?:potato|corn|tortilla|pita)\s+chips?\b", "Chips"),
    (r"\bbiscuits?\b|\bcookies?\b", "Biscuits"),
    (r"\bdips?\b", "Dips"),
    (r"\b(?:yoghurt|yogurt)\b", "Yoghurt"),
    (r"\bmilk$", "Milk"),
    (r"\bcapers?\b", "Capers"),
    (r"\b(?:vegetable|chicken|beef)\s+stock\s+cubes?\b", "Stock Cubes"),
    (r"\b(?:bread|loaf|loaves|roll|rolls|bun|buns|sourdough)\b", "Bread"),
    (r"^(?!.*\b(?:peanut|almond|cashew|hazelnut|chocolate|jam|vegemite)\b).*\b(?:margarine|table spread|vegetable oil spread|canola spread|olive oil spread|simply spread)\b", "Margarine"),
)
# Concepts (name, family, aliases).
CONCEPTS = (
    ("Green Apple", "Apple", ("green apple", "green apples")),
    ("Pink Lady Apple", "Apple", ("pink lady apple", "pink lady apples", "pink lady")),
    ("Granny Smith Apple", "Apple", ("granny smith apple", "granny smith apples", "granny smith")),
    ("Royal Gala Apple", "Apple", ("royal gala apple", "royal gala apples", "royal gala")),
    ("Sweet Potato", "Potato", ("sweet potato", "sweet potatoes")),
    ("Spring Onion", "Onion", ("spring onion", "spring onions", "green onion", "green onions", "scallion", "scallions")),
    ("Red Onion", "Onion", ("red onion", "red onions")),
    ("Brown Onion", "Onion", ("brown onion", "brown onions")),
    ("Green Beans", "Beans", ("green bean", "green beans")),
    ("Black Beans", "Beans", ("black bean", "black beans")),
    ("Brown Rice", "Rice", ("brown rice",)),
    ("White Rice", "Rice", ("white rice",)),
    ("Basmati Rice", "Rice", ("basmati rice", "basmati")),
    ("Arborio Rice", "Rice", ("arborio rice", "arborio")),
    ("Jasmine Rice", "Rice", ("jasmine rice", "jasmine")),
    ("White Quinoa", "Quinoa", ("white quinoa",)),
    ("Snow Peas", "Peas", ("snow pea", "snow peas")),
    ("Sugar Snap Peas", "Peas", ("sugar snap pea", "sugar snap peas", "snap peas")),
    ("Corn Cob", "Corn", ("corn cob", "corn cobs", "corn on the cob")),
    ("Coriander", "Coriander", ("coriander", "coriander leaves", "cilantro", "cilantro leaves")),
    ("Dill", "Dill", ("dill", "dill herb", "dill leaves", "fresh dill")),
    ("Broccoli", "Broccoli", ("broccoli",)),
    ("Cauliflower", "Cauliflower", ("cauliflower",)),
    ("Greek Yoghurt", "Yoghurt", ("greek yoghurt", "greek yogurt", "greek style natural yoghurt", "greek style natural yogurt")),
    ("Ground Cinnamon", "Cinnamon", ("ground cinnamon",)),
    ("Feta", "Feta", ("feta", "feta cheese")),
    ("Mozzarella", "Mozzarella", ("mozzarella", "mozzarella cheese")),
    ("Margarine", "Margarine", ("margarine", "simply spread")),
    ("Seed Mix", "Seed Mix", ("seed mix", "raw nut and seed mix", "nut and seed mix")),
    ("Celery", "Celery", ("celery", "celery stick", "celery sticks", "sticks celery")),
    ("Pita Bread", "Bread", ("pita bread", "pita breads", "pita pocket bread", "pita pocket breads")),
    ("Spinach", "Spinach", ("spinach", "spinach leaves")),
    ("Peas", "Peas", ("pea", "peas")),
    ("Sage", "Sage", ("sage", "sage leaf", "sage leaves")),
    ("Thyme", "Thyme", ("thyme", "thyme leaf", "thyme leaves")),
    ("Basil Pesto", "Basil Pesto", ("basil pesto",)),
    ("Tortillas", "Tortillas", ("tortilla", "tortillas")),
    ("Salmon", "Salmon", ("salmon",)),
    ("Tomato", "Tomato", ("tomato", "tomatoes")),
    ("Parsley", "Parsley", ("parsley", "parsley leaves", "flat leaf parsley", "flat leaf parsley leaves")),
    ("Garlic", "Garlic", ("garlic", "garlic clove", "garlic cloves", "clove garlic")),
    ("Lebanese Cucumber", "Cucumber", ("lebanese cucumber", "lebanese cucumbers")),
    ("Leek", "Leek", ("leek", "leeks")),
    ("Lemon", "Lemon", ("lemon", "lemons")),
    ("Lemon Juice", "Lemon", ("lemon juice",)),
    ("Lemon Rind", "Lemon", ("lemon rind", "lemon zest", "lemon zest rind")),
    ("Extra Virgin Olive Oil", "Olive Oil", ("extra virgin olive oil", "evoo")),
    ("Olive Oil", "Olive Oil", ("olive oil", "cooking olive oil", "spray olive oil")),
    ("Beef Mince", "Beef Mince", ("beef mince", "lean beef mince", "extra lean beef mince", "minced beef")),
    ("Pine Nuts", "Pine Nuts", ("pine nut", "pine nuts")),
    ("Rolled Oats", "Oats", ("rolled oats", "traditional rolled oats", "hot oats")),
    ("Multigrain Bread", "Bread", ("multigrain bread", "crusty multigrain bread")),
    ("White Bread", "Bread", ("white bread", "white sandwich loaf", "white sandwich bread")),
    ("Soft Wholemeal Sandwich Loaf", "Bread", ("soft wholemeal sandwich loaf",)),
    ("Zucchini", "Zucchini", ("zucchini", "zucchinis", "courgette", "courgettes")),
    ("Apple", "Apple", ("apple", "apples")),
    ("Asparagus", "Asparagus", ("asparagus",)),
    ("Avocado", "Avocado", ("avocado", "avocados")),
    ("Beetroot", "Beetroot", ("beetroot", "beetroots", "beet")),
    ("Carrot", "Carrot", ("carrot", "carrots", "baby carrot", "baby carrots", "dutch carrot", "dutch carrots", "dutch carrot or baby carrot")),
    ("Baking Powder", "Baking Powder", ("baking powder",)),
    ("Broccolini", "Broccolini", ("broccolini",)),
    ("Soy Sauce", "Soy Sauce", ("soy sauce",)),
    ("Spaghetti", "Pasta", ("spaghetti",)),
)

# Departments, other names of theirs, and the words that decide, in the order in which they do.
DEPARTMENT_NAMES = ("Fruit & vegetables", "Bakery", "Meat & seafood", "Deli", "Dairy & eggs", "Frozen", "Pantry", "Confectionery", "Drinks", "Health & personal care", "Household", "Baby", "Pet", "Other")
DEPARTMENT_ALIASES = {
    "fresh produce": "Fruit & vegetables", "produce": "Fruit & vegetables", "fruit and vegetables": "Fruit & vegetables", "fruit vegetables": "Fruit & vegetables",
    "fresh meat": "Meat & seafood", "seafood": "Meat & seafood", "meat and seafood": "Meat & seafood", "meat seafood": "Meat & seafood",
    "dairy eggs and fridge": "Dairy & eggs", "dairy eggs fridge": "Dairy & eggs", "dairy and eggs": "Dairy & eggs", "dairy eggs": "Dairy & eggs", "chilled": "Dairy & eggs",
    "freezer": "Frozen", "international": "Pantry", "international foods": "Pantry", "salt": "Pantry", "salts": "Pantry", "herbs and spices": "Pantry",
    "alcoholic beverage": "Drinks", "alcoholic beverages": "Drinks", "snacks and confectionery": "Confectionery", "snacks confectionery": "Confectionery",
    "health and beauty": "Health & personal care", "health beauty": "Health & personal care", "cleaning and household": "Household", "cleaning household": "Household", "pets": "Pet",
}
DEPARTMENT_RULES = (
    ("Confectionery", "chocolate|kit kat|kitkat"),
    ("Pantry", "basil pesto|black bean|black beans|borlotti bean|borlotti beans|butter bean|butter beans|canned bean|canned beans|cannellini bean|cannellini beans|dried bean|dried beans|kidney bean|kidney beans|pesto"),
    ("Drinks", "cola|cordial|drink|energy drink|hard rated|iced tea|juice|lemonade|mineral water|soft drink|sparkling water|sports drink|water"),
    ("Fruit & vegetables", "apple|apricot|asparagus|avocado|banana|basil|bean sprouts|beetroot|broad bean|broad beans|broccoli|broccolini|cabbage|capsicum|carrot|cauliflower|celery|chilli|chives|coriander|corn|cucumber|dill|edamame|eggplant|french bean|french beans|garlic|ginger|grape|green bean|green beans|herb|kale|kiwifruit|leek|lemon|lettuce|lime|mandarin|mango|mint|mushroom|nectarine|onion|orange|oregano|parsley|pea|peas|pear|potato|pumpkin|radish|rosemary|sage|salad|spinach|spring onion|strawberry|sweet potato|thyme|rocket|tomato|watermelon|zucchini"),
    ("Meat & seafood", "barramundi|beef|chicken|fish|lamb|mince|pork|prawn|salmon|sardine|steak|trout|tuna|turkey"),
    ("Deli", "antipasto|bacon|charcuterie|ham|prosciutto|salami|sliced meat"),
    ("Dairy & eggs", "butter|cheese|cream|egg|eggs|feta|fresh milk|margarine|mozzarella|table spread|yoghurt|yogurt"),
    ("Bakery", "bagel|bread|brioche|bun|croissant|flatbread|pita|roll|toast|tortilla|tortillas|wrap"),
    ("Frozen", "frozen|ice cream"),
    ("Confectionery", "biscuit|candy|confectionery|lollies|lolly|snack bar"),
    ("Baby", "baby food|baby formula|nappies|nappy"),
    ("Pet", "cat food|dog food|pet food|pet treat"),
    ("Health & personal care", "deodorant|shampoo|soap|toothbrush|toothpaste|vitamin"),
    ("Household", "cleaner|cleaning|detergent|dishwashing|laundry|paper towel|toilet paper"),
    ("Pantry", "allspice|baking powder|bean|beans|cereal|chickpea|cinnamon|coffee|cumin|flour|honey|lentil|noodle|nut|nuts|oats|oil|pasta|pepper|pesto|quinoa|rice|salt|sauce|seed|seeds|spice|stock|sugar|tea|vinegar"),
)

# How a food item is counted, by words that its identity holds; the first that fits counts.
SHAPES = (
    ("BUNCH", ("basil", "coriander", "dill", "herb", "mint", "parsley", "spring onion")),
    ("COUNT_VARIABLE", ("apple", "apricot", "avocado", "banana", "breast", "burger patty", "chop", "drumstick", "egg", "fillet", "kiwifruit", "lemon", "lime", "mandarin", "mango", "nectarine", "onion", "orange", "peach", "pear", "portion", "salmon", "steak", "tomato")),
    ("WEIGHT_VARIABLE", ("grapes", "mince", "mushroom", "nuts", "prawns", "spinach")),
    ("PACKAGED_FIXED", ("beans", "bread", "butter", "canned", "can ", "cereal", "chopped tomatoes", "cream", "flour", "jar", "juice", "milk", "oil", "pasta", "passata", "rice", "sauce", "stock", "tomato paste", "yoghurt", "yogurt")),
)
SIZED_PRODUCE = (
    "apple", "apples", "apricot", "apricots", "avocado", "avocados", "banana", "bananas", "capsicum", "capsicums", "carrot", "carrots",
    "cucumber", "cucumbers", "kiwifruit", "lemon", "lemons", "lime", "limes", "mandarin", "mandarins", "mango", "mangoes", "mushroom", "mushrooms",
    "nectarine", "nectarines", "onion", "onions", "orange", "oranges", "peach", "peaches", "pear", "pears", "potato", "potatoes",
    "sweet potato", "sweet potatoes", "tomato", "tomatoes",
)
PREPARED_PHRASES = ("dry toasted", "lightly toasted", "freshly grated", "finely chopped", "roughly chopped", "thinly sliced", "thickly sliced")
PREPARED_WORDS = (
    "blanched", "boiled", "chopped", "cooked", "cooled", "crushed", "deseeded", "diced", "drained", "finely", "grated", "halved", "lightly", "melted",
    "minced", "peeled", "quartered", "rinsed", "roasted", "roughly", "shredded", "sifted", "sliced", "softened", "steamed", "thickly", "thinly", "toasted",
    "trimmed", "warmed",
)
TECHNICAL_PHRASES = ("css", "font style", "font weight", "font family", "text decoration", "webkit", "display flex", "align items", "justify content", "background color", "rgba", "line height", "box sizing", "border radius")
# Units under their usual name.
UNIT_NAMES = {
    "each": ("item", "items", "each", "ea", "piece", "pieces", "portion", "portions", "fillet", "fillets"),
    "g": ("gram", "grams"),
    "kg": ("kilogram", "kilograms"),
    "mL": ("millilitre", "millilitres", "milliliter", "milliliters"),
    "L": ("litre", "litres", "liter", "liters"),
}
