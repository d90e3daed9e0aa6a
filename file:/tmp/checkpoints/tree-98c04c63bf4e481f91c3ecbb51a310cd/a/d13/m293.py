x293