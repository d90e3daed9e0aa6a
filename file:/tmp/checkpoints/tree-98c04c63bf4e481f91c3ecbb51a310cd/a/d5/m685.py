x685