x274