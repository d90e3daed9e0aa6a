x81