x152