x82