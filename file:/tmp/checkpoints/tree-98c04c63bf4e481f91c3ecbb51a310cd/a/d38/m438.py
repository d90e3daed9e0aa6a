x438