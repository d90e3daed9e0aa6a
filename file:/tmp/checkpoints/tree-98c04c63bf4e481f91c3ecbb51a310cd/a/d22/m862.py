x862