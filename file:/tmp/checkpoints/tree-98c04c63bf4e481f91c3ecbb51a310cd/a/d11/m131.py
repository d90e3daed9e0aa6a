x131