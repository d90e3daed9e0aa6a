x664