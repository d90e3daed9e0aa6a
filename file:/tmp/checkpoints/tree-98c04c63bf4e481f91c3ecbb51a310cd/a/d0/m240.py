x240