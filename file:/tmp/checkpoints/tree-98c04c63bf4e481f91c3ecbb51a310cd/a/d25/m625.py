x625