x840