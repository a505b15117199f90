"""Rule tables.

Everything in this file is data. The values are fixed by the output contract (a different
spelling or a different order gives a different catalog), so they are written out as plain text
in their natural order. Every operator takes the table it needs as a parameter, with the table
below as default.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

# ---------------------------------------------------------------------------------------------
# Feed columns.
REQUIRED_COLUMNS = ["Mfg_Part_Num", "Part_Desc", "E1_Brand", "Unilog_Brand", "DIB_Brand", "Part_Manuf"]
OPTIONAL_COLUMNS = ["PART_NUMBER", "Dept", "Class", "Fine", "SKU - MY_PART_NUMBER"]
FEED_COLUMNS = REQUIRED_COLUMNS + OPTIONAL_COLUMNS
REQUIRED_VALUES = ["Mfg_Part_Num", "Part_Desc", "Part_Manuf"]

# ---------------------------------------------------------------------------------------------
# Text that stands for "no value" in a supplier feed (compared in lower case).
PLACEHOLDERS = [
    "-- unbranded --", "-- no unilog brand --", "-- no dib brand --", "-- no brand --",
    "-- none --", "-- unassigned --", "unbranded", "no brand", "n/a", "na", "null", "none",
    "-", "--", "nan", "",
]
NOISE_SUFFIXES = ["Display Only", "Discontinued", "Sample Only", "Refurbished", "Promo"]


@dataclass(frozen=True)
class CatalogRow:
    """One brand of the master catalog; the position in the list is its priority."""

    manufacturer: str
    brand: str
    keywords: tuple[str, ...]


def _catalog(text: str) -> list[CatalogRow]:
    rows = []
    for line in text.strip().splitlines():
        manufacturer, brand, keywords = (part.strip() for part in line.split("|"))
        rows.append(CatalogRow(manufacturer, brand, tuple(k.strip() for k in keywords.split(";"))))
    return rows


# Manufacturer | brand with its legal mark | keywords, first row wins.
CATALOG = _catalog("""
Rheem Manufacturing | FRIGIDAIRE® | frigidaire; pdsh; ffcd; fgid
Whirlpool Corporation | Whirlpool® | whirlpool; wdts; wdf; wdt
Freud America, Inc. | Diablo® | diablo; freud; dcb; dbd; dbds; dfb
Milwaukee Electric Tool Corporation | Milwaukee® | milwaukee; milw; 49-94-; 48-22-; 2804-; 2730-
3M | 3M™ | 3m; cubitron; stikit; scotch; 3mabr
Mirka Abrasives, Inc. | Mirka® | mirka; hiolit; abranet; 5b-332; 9a-570
Stanley Black & Decker | DEWALT® | dewalt; dewlt; dwa; dwe; dcf; dcd; black & decker/dewlt
Stanley Black & Decker | STANLEY® | stanley; fatmax
Stanley Black & Decker | IRWIN® | irwin
Philips Lighting Holding B.V. | Philips® | phillips; philips
Kichler Lighting LLC | Kichler® | kichler
Satco Products, Inc. | Satco® | satco
Makita U.S.A., Inc. | Makita® | makita
Southwire Company, LLC | Southwire® | southwire; g turner
Leviton Manufacturing Co., Inc. | Leviton® | leviton
Festool USA | Festool® | festool
Kreg Tool Company | Kreg® | kreg
Hunter Fan Company | Hunter® | hunter
Robert Bosch Tool Corporation | Bosch® | bosch; 11255; gdr; gsr; robt bosch
Schneider Electric | Square D® | square d
Cooper Lighting Solutions | Cooper Lighting® | cooper lighting
Feit Electric Company | Feit Electric® | feit electric
KYOCERA SENCO Industrial Tools, Inc. | SENCO® | senco
First Alert | First Alert® | first alert; b r k
Acuity Brands Lighting, Inc. | Lithonia Lighting® | lithonia
Streamlight, Inc. | Streamlight® | streamlight
Wera Tools Inc. | Wera® | wera
SawStop, LLC | SawStop® | sawstop; saw stop
Klein Tools, Inc. | Klein Tools® | klein; klein tools; d213; 11055
""")

# Brand spellings seen in feeds -> catalog brand.
BRAND_ALIASES = {
    "frigidaire": "FRIGIDAIRE®", "whirlpool": "Whirlpool®", "diablo": "Diablo®",
    "freud": "Diablo®", "milwaukee": "Milwaukee®", "milw": "Milwaukee®", "3m": "3M™",
    "3 m": "3M™", "mirka": "Mirka®", "dewalt": "DEWALT®", "dewlt": "DEWALT®",
    "stanley": "STANLEY®", "irwin": "IRWIN®", "bosch": "Bosch®", "makita": "Makita®",
    "philips": "Philips®", "phillips": "Philips®", "kichler": "Kichler®", "satco": "Satco®",
    "southwire": "Southwire®", "leviton": "Leviton®", "festool": "Festool®", "kreg": "Kreg®",
    "hunter": "Hunter®", "square d": "Square D®", "senco": "SENCO®",
    "first alert": "First Alert®", "lithonia": "Lithonia Lighting®",
    "streamlight": "Streamlight®", "wera": "Wera®", "sawstop": "SawStop®",
    "saw stop": "SawStop®", "klein": "Klein Tools®", "klein tools": "Klein Tools®",
}

# Fixed values: (distributor, part-number prefix or description word, real manufacturer).
DISTRIBUTORS = [
    ("appliance dealers cooperative", "PDSH", "Rheem Manufacturing"),
    ("appliance dealers cooperative", "WDTS", "Whirlpool Corporation"),
    ("appliance dealers cooperative", "FFCD", "Rheem Manufacturing"),
    ("appliance dealers cooperative", "WDF", "Whirlpool Corporation"),
    ("jam industrial supply llc", "3M", "3M"),
    ("jam industrial supply llc", "CUBITRON", "3M"),
]
FUZZY_FLOOR = 0.70


# ---------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class TaxonomyRule:
    """One leaf of the taxonomy; the position in the list is its priority."""

    product_name: str
    unspsc: str
    classpath: str
    keywords: tuple[str, ...]


def _taxonomy(text: str) -> list[TaxonomyRule]:
    rules = []
    for line in text.strip().splitlines():
        product, unspsc, classpath, keywords = (part.strip() for part in line.split("|"))
        rules.append(TaxonomyRule(product, unspsc, classpath, tuple(k.strip() for k in keywords.split(";"))))
    return rules


# Product | UNSPSC | classpath | keywords. Keywords match anywhere in the text and
# the first rule with a hit wins; keywords that cannot decide in the given order leave the plan.
TAXONOMY = _taxonomy("""
Laser Level | 27111800 | Test & Measurement > Measuring & Layout Tools > Laser Levels & Line Lasers | cross line laser; line laser; laser - green; laser green; cross line; laser level; plumb spots; 3 spot; 5 spot; laser
Measuring & Layout Tool | 27111800 | Hand Tools > Measuring & Layout Tools > Squares, Calipers & Chalk Lines | raftersquare; rafter - square; rafter square; bigcal; caliper; chalk & reel; chalk reel; chalk line
Voltage Detector | 41113600 | Test & Measurement > Electrical Testing > Voltage Detectors & Meters | voltage detector; voltage tester; detector
Impact Driver | 27112713 | Power Tools > Drills & Drivers > Impact Drivers | hydraulic driver; surge kit; screwdriver - autofeed; autofeed
Impact Wrench | 27112700 | Power Tools > Fastening Tools > Impact Wrenches | impact wrench; impact - wrench; angle impact; stubby; impact - bare tool; impact
Power Ratchet | 27112700 | Power Tools > Fastening Tools > Cordless & Electric Ratchets | rachet; ratchet
Power Sander | 27112700 | Power Tools > Woodworking & Metalworking Tools > Power Sanders & Polishers | sander; polisher; band file; spindle sander; deos663xcv; deos
Woodworking Router | 27112700 | Power Tools > Woodworking Tools > Routers & Joiners | router; plunge - router; plunge router
Woodworking Planer | 23101500 | Machinery & Equipment > Woodworking Machinery > Planers & Jointers | planer; planing machine; jointer
Woodworking Shaper | 23101500 | Machinery & Equipment > Woodworking Machinery > Shapers & Feeders | shaper; stock feeder
Rotary Tool | 27112700 | Power Tools > Rotary & Oscillating Tools > Rotary Tool Kits | rotary tool; dremel
Power Trimmer | 27112700 | Outdoor Power Equipment > Trimmers & Edgers > String & Hedge Trimmers | string trimmer; hedge trimmer; trimmer
Power Blower | 27112700 | Outdoor Power Equipment > Blowers & Vacuums > Leaf Blowers | precision blower; blower
Dust Extractor | 47121600 | Power Tools > Dust Collection & Vacuums > Dust Extractors & Filters | dust extractor; extractor-ct; paper bag; dust bag
Jobsite Speaker | 52161512 | Jobsite Equipment > Jobsite Radios & Electronics > Jobsite Speakers | jobsite speaker; bluetooth speaker; speaker
Socket & Wrench Set | 27111700 | Hand Tools > Wrenches & Sockets > Socket & Wrench Sets | mechanics set; packout 15pc; packout 30pc; wrench set; universal joint
Hand File | 27111900 | Hand Tools > Cutting & Shaping Tools > Files & Rasps | file bstd; file bstd mill; file
Folding Knife | 27111500 | Hand Tools > Knives & Cutting Tools > Utility & Pocket Knives | folding knife; pocket knife; knife
Aviation Snips | 27111500 | Hand Tools > Snips & Shears > Aviation Snips | mini snip; snip red; snip green; snip
Hex Key Set | 27111700 | Hand Tools > Hex & Torx Keys > Hex Key Sets | hex plus; hex key; allen key
Hearing Protector | 46181900 | Safety & PPE > Hearing Protection > Ear Muffs | hearing protector; ear muff
Tool Holster | 24112400 | Tool Storage & Belts > Holsters & Pouches > Tool Holsters | phone holster; holster; tool pouch; tool belt
Battery Starter Kit | 26111700 | Power Tools > Power Tool Accessories > Battery & Charger Kits | starter kit; flexvolt starter; 2pc kit; battery kit; starter
Power Tool Accessory | 27112800 | Power Tool Accessories > Cutting & Fastening Accessories > Specialty Tool Accessories | framing magazine; collated attach; screw setter; plug cutter; dado pro; hole dozer; planer knives; xtender fence; fence; systainer abrasive set; iridium grip
Chandelier | 39111500 | Lighting & Fans > Indoor Lighting > Ceiling Lights > Chandeliers | chandelier; chand lt; chand
Pendant Light | 39111500 | Lighting & Fans > Indoor Lighting > Ceiling Lights > Pendant Lights | pendant lt; pendant
Wall Light | 39111500 | Lighting & Fans > Indoor Lighting > Wall Lights > Sconces & Vanity | wall lt; wall light; sconce; bath light; vanity
Downlight | 39111500 | Lighting & Fans > Indoor Lighting > Recessed Lighting > Downlights | down light; downlight; recessed
Commercial Light Fixture | 39111500 | Lighting & Fans > Commercial Lighting > High Bay & Strip Fixtures | strip light; highbay; troffer; wrap light; shop light
Ceiling Light | 39111500 | Lighting & Fans > Indoor Lighting > Ceiling Lights > Flush Mounts | ceiling lt; ceiling light; flush mount
Outdoor Light | 39111600 | Lighting & Fans > Outdoor Lighting > Security & Flood Lights | motion lt; nano clip light; floodlight; lantern; spotlight; post lt
Portable Work Light | 39111610 | Lighting & Fans > Portable & Work Lighting > Flashlights & Work Lights | flashlight; flashlt; flash light; headlight; work light; rechargeable; dcl183; slyde king; light - rechargeable
LED Light Bulb | 39101628 | Lighting & Fans > Light Bulbs & Lamps > LED Bulbs | br30; a19; par38; par30; cand; led; lamp; bulb; 27k; 50k; 30k; phillips lighting; satco
Ceiling Fan | 40101600 | Lighting & Fans > Ceiling Fans & Accessories > Ceiling Fans | ceiling fan; fan; hunter fan
Dishwasher | 52141505 | Appliances & Consumer Electronics > Kitchen Appliances > Built-In Dishwashers | dishwasher; dish washer
Refrigerator | 52141501 | Appliances & Consumer Electronics > Kitchen Appliances > Refrigerators & Freezers | fridge; refrigerator; freezer
Microwave Oven | 52141507 | Appliances & Consumer Electronics > Kitchen Appliances > Microwave Ovens | microwave; mocrowave; otr
Cooking Appliance | 52141502 | Appliances & Consumer Electronics > Kitchen Appliances > Ranges, Ovens & Cooktops | wall oven; cooktop; range; oven
Beverage Center | 52141501 | Appliances & Consumer Electronics > Kitchen Appliances > Specialty Refrigeration | beverage center; wine cooler
Coffee & Espresso Maker | 52141526 | Appliances & Consumer Electronics > Small Kitchen Appliances > Coffee & Espresso Makers | coffee maker; espresso; café; cafe
Laundry Appliance | 52141600 | Appliances & Consumer Electronics > Laundry Appliances > Washers & Dryers | laundry center; washer; dryer; laundry
Heating Component | 40101800 | HVAC & Refrigeration > Heating Equipment > Space Heaters & Kits | heater kit; heater; hvac; thermostat
Load Center / Panel | 39121100 | Electrical > Distribution Equipment & Panels > Load Centers & Circuit Breakers | load center; load cntr; panelboard; breaker; square d
Wiring Device | 39122200 | Electrical > Wiring Devices & Light Controls > Switches, Outlets & Dimmers | outlet; receptacle; dimmer; switch; decor plate; wallplate; box cover; leviton; lutron; cooper wiring
Power Supply / Charger | 26111700 | Electrical > Power Supplies & Batteries > Battery Chargers & Power Packs | charger; power supply; power source; battery; jumpstart; pwr supply
Heated Apparel | 46181500 | Safety & PPE > Workwear & Apparel > Heated Workwear | heated hoodie; heated gear; jacket; vest
Electrical Supply | 39121400 | Electrical > Wire, Cable & Accessories > Electrical Tape & Wire | elect tape; vinyl elect; wire; cable; cord
Cut-Off Disc | 31191600 | Abrasives > Cutting & Grinding Wheels > Cut-Off Wheels | cut-off disc; cut off disc; cut-off wheel; metal cut off; cut off wheel; cut-off; cut and grind; cut n grind; grind disc
Sanding Sponge | 31191500 | Abrasives > Sandpaper & Sanding Discs > Sanding Sponges & Blocks | sanding sponge; sanding block
Sanding Disc / Belt | 31191500 | Abrasives > Sandpaper & Sanding Discs > Sanding Belts & Discs | sanding belt; sanding disc; stikit film; abranet; hiolit; sandpaper; gr pro
Grinding Wheel | 31191600 | Abrasives > Cutting & Grinding Wheels > Grinding Wheels & Flap Discs | grinder; flap disc; grinding wheel
Driver Bit | 27112800 | Power Tool Accessories > Screwdriver Bits & Fastener Drivers > Driver Bits | phillips bit; drive bit; drill bit; bit 5pk; bit
Power Saw | 27112700 | Power Tools > Saws > Circular & Table Saws | circ saw; circular saw; table saw; miter saw; saw
Cutting Blade | 27112800 | Power Tool Accessories > Saw Blades & Accessories > Circular & Planer Blades | planer blade; saw blade; blade 2pc; blade
Grease Gun | 27112900 | Machinery & Equipment > Lubrication Equipment > Grease Guns | grease gun; lubrication
Power Drill / Driver | 27112700 | Power Tools > Drills & Drivers > Cordless Drills & Drivers | drill driver; impact driver; drill; grinder 7-9
Decking Board | 30103600 | Building Materials > Decking & Railing > Composite & PVC Decking | decking; fascia; trex; azek; timbertech
Railing / Post Component | 30103600 | Building Materials > Decking & Railing > Railing & Post Systems | rail kit; post trim; post sleeve; support post; blank post; post cap; post wrap; gate; baluster
Lumber & Siding | 30151600 | Building Materials > Lumber & Composites > Siding, Trim & Moulding | doug fir; lumber; cedar; soffit; soff; smart lap; smart pan; shiplap; fissured; osb; sub floor; blue plus; hardieplank; hardie; siding; shingle; duration trudef
Window / Door System | 30171500 | Building Materials > Windows, Doors & Skylights > Residential Windows & Doors | skylt; skylight; patio dr; slider; hopper; attic access door; window; door; inside cas; wrapped
Building Envelope & Sheathing | 30151600 | Building Materials > Siding, Roofing & Sheathing > Weather Barriers & Siding | rainscreen; eaveguard; ice guard; sheathing
Sealant / Weatherproofing | 31201500 | Building Materials > Weatherproofing & Sealants > Tapes & Mortars | mortar; emseal; joist tape; protecto wrap; tape; sealant; threshold
Metal Panel | 30151600 | Building Materials > Metal Roofing & Siding > Metal Panels | premier rib; metal panel
Fastener / Nail | 31162000 | Hardware > Fasteners > Nails & Staples | nail; finish nail; staple; senco; prebena
Tool Storage | 24112400 | Storage & Material Handling > Tool Storage > Tool Chests & Boxes | tool chest; organizer; tool box; storage
Layout & Marking Tool | 27111800 | Hand Tools > Measuring & Layout Tools > Squares & Marking Tools | t-square; pencil; lead; wal-board; marking; layout
Insulated Drinkware | 49121500 | Outdoor & Jobsite Equipment > Drinkware & Coolers > Insulated Bottles | bottle - insulated; bottle; tumbler; cooler
Hardware Fitting | 31162400 | Hardware > Architectural & General Hardware > Brackets, Latches & Fasteners | latch; hanger; bracket; adjust hanger; mason line; gravity latch
Sink Faucet | 30181702 | Plumbing > Faucets & Fixtures > Kitchen & Bath Sink Faucets | faucet; sink faucet; lavatory faucet; kitchen faucet
Pipe Fitting | 40141700 | Plumbing > Pipe, Tube & Hose Fittings > Pipe Fittings | cplg; coupling; fitting; elbow; tee; adapter; bushing; nipple; valve
Fire & Safety Alarm | 46191500 | Safety & Security > Fire Protection & Alarms > Fire Extinguishers & Smoke Detectors | fire extinguisher; smoke & co alarm; smoke alarm; co alarm; firewatch; first alert; driveway alert
Safety Equipment | 46181500 | Safety & PPE > Eye, Hand & Body Protection > Safety Gear | eyewear; glasses; glove; mask; respirator; earplug; kneeling pad; safety; edge eyewear
Measurement Gauge | 41112400 | Test & Measurement > Pressure & Electrical Measurement > Gauges & Meters | tire pressure; inflator gauge; gauge; meter; multimeter; caliper
""")
FALLBACK_RULE = TaxonomyRule("Hardware Component", "", "Industrial Supplies & MRO > General Hardware", ())
GENERIC_MARK = "General Hardware"

# ---------------------------------------------------------------------------------------------
# Brand fragment -> first-party domain, and shop domains that must never be linked.
DOMAINS = dict(
    line.split(" = ")
    for line in """
freud = freudtools.com
diablo = diablotools.com
3m = 3m.com
mirka = mirka.com
nibco = nibco.com
rheem = rheem.com
whirlpool = whirlpool.com
frigidaire = frigidaire.com
electrolux = electrolux.com
bosch = boschtools.com
dewalt = dewalt.com
makita = makitatools.com
milwaukee = milwaukeetool.com
metabo = metabo.com
hilti = hilti.com
fein = fein.com
lenox = lenoxtools.com
irwin = irwin.com
klein = kleintools.com
channellock = channellock.com
ridgid = ridgid.com
oregon = oregonproducts.com
senco = senco.com
paslode = paslode.com
simpson = simpsonstrong-tie.com
simpson strong = simpsonstrong-tie.com
trex = trex.com
azek = azek.com
timbertech = timbertech.com
james hardie = jameshardie.com
hardie = jameshardie.com
hunter = hunterfan.com
satco = satco.com
philips = philips.com
leviton = leviton.com
lutron = lutron.com
square d = se.com
schneider = se.com
siemens = siemens.com
eaton = eaton.com
abb = abb.com
honeywell = honeywell.com
first alert = firstalert.com
kidde = kidde.com
moen = moen.com
delta faucet = deltafaucet.com
kohler = kohler.com
american standard = americanstandard.com
oatey = oatey.com
charlotte pipe = charlottepipe.com
apollo = apollovalves.com
watts = watts.com
bradford white = bradfordwhite.com
ao smith = hotwater.com
lochinvar = lochinvar.com
trane = trane.com
carrier = carrier.com
lennox = lennox.com
goodman = goodmanmfg.com
napoleon = napoleon.com
weber = weber.com
edge eyewear = edgeeyewear.com
pyramex = pyramex.com
3a safety = 3asafety.com
mcr safety = mcrsafety.com
pip = pipsafety.com
ergodyne = ergodyne.com
milwaukee leather = milwaukee-leather.com
stanley = stanleytools.com
craftsman = craftsman.com
ryobi = ryobitools.com
porter cable = portercable.com
grizzly = grizzly.com
jet tools = jettools.com
sawstop = sawstop.com
festool = festool.com
sharkblade = sharkblade.com
starrett = starrett.com
empire = empirelevel.com
johnson = johnsonlevel.com
stiletto = stilettotools.com
estwing = estwing.com
vaughan = vaughanbushnell.com
crescent = crescenttool.com
proto = prototools.com
westward = westwardtools.com
""".strip().splitlines()
)
SHOP_DOMAINS = [
    "amazon.", "amzn.", "ebay.", "walmart.", "alibaba.", "aliexpress.", "homedepot.", "lowes.",
    "menards.", "acehardware.", "target.", "etsy.", "wish.", "overstock.", "wayfair.",
    "grainger.", "zoro.",
]

# ---------------------------------------------------------------------------------------------
# Standard unit, then the spellings that mean it (compared in lower case).
_UNITS = """
in | in; in.; inch; inches; "; ''
ft | ft; ft.; foot; feet; '
yd | yd; yard; yards
mm | mm; millimeter; millimeters
cm | cm; centimeter; centimeters
m | m; meter; meters
V | v; volt; volts; vac; vdc; v ac; v dc
A | a; amp; amps; ampere; amperes
W | w; watt; watts
kW | kw; kilowatt; kilowatts
kW-hr | kw-hr; kwh; kw/hr; kw - hr; kwhr
Hz | hz; hertz
hp | hp; horsepower
dBA | dba; db; decibel; decibels; dBA
lb | lb; lbs; lb.; pound; pounds
oz | oz; oz.; ounce; ounces
kg | kg; kilogram; kilograms
g | g; gram; grams
psi | psi; psig; lbs/sq in
gpm | gpm; gallons per minute
cfm | cfm; cubic feet per minute
rpm | rpm; revolutions per minute
hr | hr; hour; hours; hrs
min | min; minute; minutes
sec | sec; second; seconds
deg F | deg f; degf; °f; fahrenheit
deg C | deg c; degc; °c; celsius
pc | pc; piece; pieces; pcs
pk | pk; pack; packs
ct | ct; count
box | box; boxes
roll | roll; rolls
set | set; sets
pair | pair; pairs
ga | ga; gauge
grit | grit
"""
UNITS = {
    spelling.strip(): unit.strip()
    for unit, spellings in (line.split("|") for line in _UNITS.strip().splitlines())
    for spelling in spellings.split(";")
}
TRADE_FRACTION_UNITS = ["in", "ft", "yd"]


def fraction_table(denominator: int) -> list[str]:
    """Reduced fractions 1/d .. (d-1)/d; index 0 is the value 1/d."""
    out = []
    for n in range(1, denominator):
        g = gcd(n, denominator)
        out.append(f"{n // g}/{denominator // g}")
    return out


# ---------------------------------------------------------------------------------------------
# Words read out of a description. Order matters, the first hit wins.
SERIES = [
    "Enhance Naturals", "Transcend Lineage", "Vintage", "Landmark", "Steel Demon", "Speed Demon",
    "Cubitron II", "Cubitron™ II", "Abranet", "Hiolit", "Professional Series", "Eco Series",
    "Duration TruDef", "Blue Plus", "Stikit",
]
MATERIALS = [
    ("ss", "Stainless Steel"), ("sst", "Stainless Steel"), ("bss", "Stainless Steel"),
    ("stainless", "Stainless Steel"), ("stainless steel", "Stainless Steel"), ("brs", "Brass"),
    ("brass", "Brass"), ("bronze", "Bronze"), ("steel", "Steel"), ("pvc", "PVC"), ("cpvc", "CPVC"),
    ("ci", "Cast Iron"), ("cast iron", "Cast Iron"), ("copper", "Copper"), ("alum", "Aluminum"),
    ("aluminum", "Aluminum"), ("vinyl", "Vinyl"), ("osb", "OSB"), ("composite", "Composite"),
    ("hardie", "HardiePlank"), ("hardieplank", "HardiePlank"), ("cedar", "Cedar"),
    ("doug fir", "Douglas Fir"), ("fir", "Douglas Fir"), ("mortar", "Mortar"),
]
FINISHES = [
    ("bk", "Black"), ("blk", "Black"), ("dbk", "Black"), ("black", "Black"), ("wh", "White"),
    ("wn", "White"), ("white", "White"), ("ch", "Chrome"), ("chrome", "Chrome"),
    ("ni", "Brushed Nickel"), ("brushed nickel", "Brushed Nickel"), ("bn", "Brushed Nickel"),
    ("cpz", "Champagne Bronze"), ("avi", "Anvil Iron"), ("charcoal", "Charcoal"),
    ("coastline", "Coastline"), ("french white oak", "French White Oak"),
    ("american walnut", "American Walnut"), ("honey grove", "Honey Grove"),
    ("golden hour", "Golden Hour"), ("carmel", "Carmel"), ("clay", "Clay"),
    ("dark chocolate", "Dark Chocolate"), ("light buff", "Light Buff"), ("juniper", "Juniper"),
    ("gray", "Gray"),
]
MPN_FINISHES = [
    ("BKCLR", "Black / Clear"), ("BKCS", "Black / Clear Seeded Glass"), ("DBK", "Black"),
    ("CPZ", "Champagne Bronze"), ("AVI", "Anvil Iron"), ("BSS", "Stainless Steel"),
    ("SST", "Stainless Steel"), ("SS", "Stainless Steel"), ("NI", "Brushed Nickel"),
    ("BN", "Brushed Nickel"), ("BK", "Black"), ("WH", "White"), ("CH", "Chrome"),
    ("BRS", "Brass"), ("SBE", "Black"), ("SJP", "Juniper"), ("KPS", "Stainless Steel"),
    ("SPS", "Stainless Steel"), ("WE", "White"), ("BE", "Black"), ("WHA", "White"),
]
DECKING_COLORS = [
    "Biscayne", "Jasper", "Hatteras", "Salt Flat", "Tide Pool", "Pebble Beach", "Malted Barley",
    "Millstone", "Whiskey Barrel", "Island Mist", "Rainier", "Vintage Lantern", "Spiced Rum",
    "Gravel Path", "Rope Swing", "Tiki Torch", "Lava Rock", "Havana Gold", "Tree House",
    "Clam Shell", "Saddle", "Winchester Gray", "Woodland Brown", "Fire Pit", "Cosmopolitan",
    "Bungalow", "Stone Gray", "Slate Gray", "Brownstone",
]
PIPE_NOUNS = [
    "cplg", "coupling", "elbow", "tee", "nipple", "bushing", "adapter", "cap", "plug", "union",
    "cross", "reducer", "street", "valve", "mpt", "fpt", "fnpt", "mnpt", "npt", "cxc", "fxf",
    "mxm", "mxf", "fxm",
]
FASTENER_WORDS = [
    "screw", "bolt", "nut", "anchor", "lag", "threaded", "fastener", "hex cap", "deck screw", "drywall screw",
]
ABRASIVE_WORDS = [
    "cut-off", "cut off", "grind", "sanding", "sand", "disc", "wheel", "abrasive", "cubitron", "stikit",
    "hiolit", "steel demon", "speed demon", "flap", "abrasanet", "abranet",
]
FITTING_WORDS = [
    "cplg", "coupling", "elbow", "nipple", "bushing", "fnpt", "mnpt", "push-fit", "push fit",
    "ball valve", "gate valve", "check valve",
]
APPLIANCE_WORDS = [
    "dishwasher", "refrigerator", "microwave", "cooking appliance", "laundry appliance",
    "beverage center", "coffee",
]
COATINGS = [
    ("mechanically galvanized", "Mechanically Galvanized"), ("hot dip galvanized", "Hot Dip Galvanized"),
    ("galvanized", "Galvanized"), ("zinc plated", "Zinc Plated"), ("zinc", "Zinc Plated"),
    ("black oxide", "Black Oxide"), ("black phosphate", "Black Phosphate"),
    ("ceramic coated", "Ceramic Coated"), ("dacrotized", "Dacrotized"), ("bright", "Bright"),
    ("yellow dichromate", "Yellow Dichromate"),
]
HEADS = [
    "hex head", "pan head", "flat head", "round head", "truss head", "bugle", "wafer head",
    "modified truss", "oval head",
]
DRIVES = [
    "phillips", "torx", "star drive", "square drive", "slotted", "hex socket", "allen",
    "combo drive", "quadrex",
]

# Words shortened in invoice texts, and supplier codes dropped from mobile texts.
ABBREVIATIONS = {
    "DISHWASHER": "DISHWASH", "REFRIGERATOR": "FRIDGE", "STAINLESS STEEL": "SS",
    "STAINLESS": "SS", "BUILT-IN": "BLT-IN", "STANDARD": "STD", "CLEANBOOST": "CLN-BST",
    "VOLTS": "V", "VOLT": "V", "AMPERE": "A", "AMPS": "A", "INCH": "IN", "INCHES": "IN",
    "MOUNT": "MNT", "CUT-OFF DISC": "CUT-OFF DISC", "SANDING DISC": "SAND DISC",
    "GRINDING WHEEL": "GRIND WHL", "LIGHT BULB": "LED BULB", "CHANDELIER": "CHAND",
    "PENDANT LIGHT": "PENDANT", "WALL LIGHT": "WALL LT", "DOWNLIGHT": "DOWN LT",
}
SUPPLIER_CODES = [
    "4031", "2435", "JAMIN", "MIRUS", "KICLI", "5831", "BOICA", "APPDE", "6151", "2585", "3073",
    "5573", "5142", "6603", "4927", "FESTO", "TECGE", "KRETO", "6694", "EDGSA", "PALDO", "4381",
    "PREME", "VESTO", "OLIMA",
]

# Nouns that make even a very short description meaningful.
PRODUCT_NOUNS = (
    "dishwasher refrigerator fridge freezer microwave washer dryer faucet valve fitting coupling "
    "elbow tee nipple bushing disc wheel belt blade bit drill driver saw sander grinder lamp bulb "
    "light fixture chandelier pendant sconce outlet switch dimmer panel board decking fascia "
    "railing post skylight door window sheathing siding mortar tape screw bolt nut anchor latch "
    "hanger glove glasses mask gauge meter apparel hoodie jacket bottle chest box"
).split()

# ---------------------------------------------------------------------------------------------
# Quality limits.
INVOICE_MAX = 40
MOBILE_MAX = 85
MOBILE_LOW, MOBILE_HIGH = 60, 80
CONFIDENCE_FLOOR = 80.0
MAX_FEATURES = 20
REVIEW_CATEGORIES = [
    "low_confidence", "schema_failure", "no_attributes", "generic_taxonomy", "description_issue",
    "export_issue", "processing_error", "missing_required_field",
]
CHANNEL_LIMITS = {"invoice_desc": 40, "mobile_desc": 85, "short_desc": 120, "long_desc1": 1000, "retail_desc": 500}

# ---------------------------------------------------------------------------------------------
# The delivery contract. Numbered slots are generated.
ATTRIBUTE_SLOTS = 50
FEATURE_SLOTS = 20
REF_URL_SLOTS = 5
_LEADING = (
    ["MFR URL"]
    + [f"Ref URL {i}" for i in range(1, REF_URL_SLOTS + 1)]
    + """PART_NUMBER;Dept;Class;Fine;SKU - MY_PART_NUMBER;Mfg_Part_Num;Part_Desc;E1_Brand;Unilog_Brand;DIB_Brand;
Part_Manuf;MANUFACTURER_NAME;BRAND_NAME;TRADE_NAME;MANUFACTURER_PART_NUMBER;ALTERNATE_PART_NUMBER;Classpath;
MOBILE_DESC;INVOICE_DESC;SHORT_DESC;LONG_DESC1;RETAIL_DESC;MARKETING_DESCRIPTION""".replace("\n", "").split(";")
    + [f"ITEM_FEATURES_{i}" for i in range(1, FEATURE_SLOTS + 1)]
    + "With;Standard/Approvals;Prop 65;Application;Includes;Product Name".split(";")
)
_TRAILING = """UPC;EAN;GTIN;UNSPSC;Warranty;List Price;Selling Qty;Selling UOM;Standard Packaging Information;LENGTH;
LENGTH_UOM;HEIGHT;HEIGHT_UOM;WIDTH;WIDTH_UOM;WEIGHT;WEIGHT_UOM;VOLUME;VOLUME_UOM;Product Image;Alternate Image 1;
Alternate Image 2;Alternate Image 3;Alternate Image 4;SDS;SDS_1;Warranty Information;Catalog;Specification Sheet;
Instruction/Installation Manual;Service Manual;Owners/User Manual;Line Drawing;MTR;RoHS;Full Engineering Drawing;
Energy Star Guide;Technical Bulletin;Submittal;Compatibility Chart;Size Chart;Product Label/Insert;Video Link;
Video Link 1;Country Of Origin;Discontinued;Actual Image (Yes/No)""".replace("\n", "").split(";")
DELIVERY_COLUMNS = (
    _LEADING
    + [f"ATTRIBUTE_{part} {i}" for i in range(1, ATTRIBUTE_SLOTS + 1) for part in ("LABEL", "VALUE", "UOM")]
    + _TRAILING
)

# Delivery column -> field of the enriched record, and the columns scored against truth.
DELIVERY_FIELDS = {
    "MFR URL": "mfr_url", "MANUFACTURER_NAME": "manufacturer_name", "BRAND_NAME": "brand_name",
    "MANUFACTURER_PART_NUMBER": "mfg_part_num", "Classpath": "classpath",
    "MOBILE_DESC": "mobile_desc", "INVOICE_DESC": "invoice_desc", "SHORT_DESC": "short_desc",
    "LONG_DESC1": "long_desc1", "RETAIL_DESC": "retail_desc",
    "MARKETING_DESCRIPTION": "marketing_description", "Product Name": "product_name", "UNSPSC": "unspsc",
}
SCORED_FIELDS = [
    "MANUFACTURER_NAME", "BRAND_NAME", "MANUFACTURER_PART_NUMBER", "Classpath", "UNSPSC", "Product Name",
    "INVOICE_DESC", "MOBILE_DESC", "SHORT_DESC", "LONG_DESC1", "RETAIL_DESC",
]
