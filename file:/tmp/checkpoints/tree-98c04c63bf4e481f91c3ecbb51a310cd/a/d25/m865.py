x865