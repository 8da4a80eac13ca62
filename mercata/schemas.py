"""Declared schemas; nothing is inferred on read."""

POINT = "struct<lat:double,lon:double>"

OSM_DOCUMENT = (
    "version double, elements array<struct<type:string,id:bigint,lat:double,"
    f"lon:double,center:{POINT},tags:map<string,string>>>")
REGIONS = ("region_id string, name string, lat double, lng double, "
           "source string, created_at timestamp")
SHOPS = ("shop_id string, osm_id bigint, name string, categories array<string>, "
         "lat double, lng double, address string, source string, "
         "fetched_at string")
INVENTORY = ("shop_id string, sku string, name string, category string, "
             "price double, currency string, qty int, synthetic boolean, "
             "source string, rating double, review_count int, updated_at string")
CATALOG_ENTRIES = ("array<struct<sku:string,name:string,base_price_eur:double,"
                   "rating:double,review_count:int,source:string>>")
PRODUCT_DUMP = (
    "products array<struct<id:bigint,title:string,description:string,"
    "category:string,price:double,rating:double,thumbnail:string,"
    "tags:array<string>,reviews:array<struct<rating:double>>>>")
SNAPSHOTS = ("id string, keyword string, geo string, timeframe string, "
             "provider string, captured_at string, "
             "series array<struct<date:string,value:double>>, "
             "region_breakdown array<struct<region:string,value:double>>")
# Numbers arrive as text: the payload promises no types.
TIMESERIES_PAYLOAD = (
    "interest_over_time struct<timeline_data:array<struct<timestamp:string,"
    "values:array<struct<query:string,extracted_value:string>>>>>, broken string")
RISING_PAYLOAD = (
    "related_queries struct<rising:array<struct<query:string,value:string,"
    "extracted_value:string>>>, broken string")
RAW_EVENTS = ("type string, shop_id string, shop string, sku string, "
              "name string, qty_now bigint, sold bigint, added bigint, "
              "ts double")
