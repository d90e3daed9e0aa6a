x957