x813