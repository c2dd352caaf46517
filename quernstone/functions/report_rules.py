"""Rule tables for medical reports, in the order in which they apply."""

# Organ of a finding, first match wins.
ORGANS = (
    (r"甲状腺", "甲状腺"),
    (r"乳腺|乳房", "乳腺"),
    (r"肝左叶|肝右叶|肝脏|肝叶|肝", "肝脏"),
    (r"胆囊", "胆囊"),
    (r"胆总管|胆管", "胆管"),
    (r"胰腺|胰头|胰体|胰尾", "胰腺"),
    (r"脾脏|脾", "脾脏"),
    (r"左肾|右肾|双肾|肾脏|肾", "肾脏"),
    (r"膀胱", "膀胱"),
    (r"前列腺", "前列腺"),
    (r"子宫内膜|宫腔|子宫", "子宫"),
    (r"宫颈", "宫颈"),
    (r"左侧卵巢|右侧卵巢|双侧卵巢|卵巢", "卵巢"),
    (r"盆腔", "盆腔"),
    (r"左肺|右肺|双肺|肺部|肺叶|肺", "肺"),
    (r"心脏|心室|心房", "心脏"),
    (r"颈动脉", "颈动脉"),
    (r"椎动脉", "椎动脉"),
    (r"锁骨下动脉", "锁骨下动脉"),
    (r"下肢动脉", "下肢动脉"),
    (r"淋巴结", "淋巴结"),
    (r"食管", "食管"),
    (r"胃部|胃", "胃"),
    (r"结肠|直肠|小肠|肠道", "肠道"),
    (r"眼底|眼球|眼", "眼"),
    (r"鼻腔|鼻窦|鼻", "鼻"),
    (r"咽喉|咽部|喉部", "咽喉"),
    (r"口腔|牙龈|牙齿", "口腔"),
    (r"骨骼|骨质|骨", "骨骼"),
)

# Type of a finding, first match wins.
FINDING_TYPES = (
    (r"囊肿|囊性灶", "囊肿"),
    (r"结节", "结节"),
    (r"斑块", "斑块"),
    (r"息肉", "息肉"),
    (r"结石", "结石"),
    (r"钙化", "钙化"),
    (r"肿块|包块|团块|占位|肿物", "肿块"),
    (r"积液", "积液"),
    (r"增生", "增生"),
    (r"萎缩", "萎缩"),
    (r"狭窄", "狭窄"),
    (r"扩张|增宽", "扩张"),
    (r"卵泡", "卵泡"),
    (r"脂肪肝|脂肪变", "脂肪肝"),
    (r"淋巴结", "淋巴结"),
    (r"厚度|壁厚|内膜厚", "厚度"),
    (r"大小|体积", "大小"),
    (r"位置|前位|后位", "位置"),
    (r"回声", "回声"),
    (r"形态|边界|轮廓", "形态"),
    (r"血流", "血流"),
    (r"密度", "密度"),
    (r"数量|数目", "数量"),
)

# Region within an organ; the first pattern found gives the text.
REGIONS = (
    r"左叶|右叶|上叶|中叶|下叶|峡部",
    r"上极|中极|下极",
    r"胰头|胰体|胰尾",
    r"胆囊颈|胆囊体|胆囊底",
    r"宫腔|内膜",
    r"上段|中段|下段",
    r"\d{1,2}\s*点钟(?:方向)?",
)

# Side of a finding, from text, where none is given.
SIDES = (
    (r"双侧|双肾|双肺|双乳|双卵巢", "bilateral"),
    (r"左侧|左叶|左肺|左肾|左乳|左卵巢", "left"),
    (r"右侧|右叶|右肺|右肾|右乳|右卵巢", "right"),
    (r"正中|中线", "midline"),
)

# Lexicons that decide whether a finding can be tracked.
TRACKABLE = (
    r"囊肿|囊性灶|结节|斑块|息肉|结石|钙化灶?|占位|肿块|包块|团块|积液|增生|萎缩|狭窄|扩张|卵泡|脂肪肝|磨玻璃影|病灶|淋巴结"
    r"|低回声(?:区|灶)?|高回声(?:区|灶)?|无回声(?:区|灶)?|混合回声(?:区|灶)?|密度影|异常信号|肿大|增大|增厚|变薄|缩小|不均匀|粗糙"
    r"|迂曲|反流|硬化|炎症|化生|异型|腺瘤|肿瘤|癌|坏死|溃疡|糜烂|疝|静脉曲张|赘生物|瘢痕|出血|水肿"
)
TRACKABLE_ABSENT = (
    r"囊肿|囊性灶|结节|斑块|息肉|结石|钙化灶?|占位|肿块|包块|团块|积液|磨玻璃影|病灶|异常肿大淋巴结|腺瘤|肿瘤|癌|溃疡|糜烂|疝|静脉曲张|赘生物|出血"
)
GENERIC_NORMAL = (
    r"(未见|未发现|无)(?:明显|特殊|显著)?(?:的)?(?:异常|异常表现|异常改变|病变|占位性病变)|大致正常|基本正常"
    r"|(?:大小|形态|结构|轮廓|边界|包膜|回声|密度|血流)(?:及|、|与|和|均|尚)*正常|形态规则|边界清晰|包膜完整|回声均匀"
)
PLACEHOLDER = r"^(?:检查发现|形态发现|异常|异常表现|检查异常|影像发现|超声发现|其他|待确认|未明确)$"

# Weighted signals of each kind of report.
REPORT_KINDS = {
    "checkup": ((r"健康体检(?:报告|档案)|体检报告|体检套餐", 10), (r"总检结论|体检综述|阳性发现|异常汇总", 8), (r"一般检查|基础测量|人体成分|体检编号", 5)),
    "laboratory": (
        (r"检验报告|化验报告|医学检验|临床检验", 9), (r"标本(?:类型|名称|性状|编号)|采样时间|检验方法", 5),
        (r"(?:项目|名称).{0,20}(?:结果|测定值).{0,30}(?:参考|范围|单位)", 7),
        (r"血常规|尿常规|便常规|肝功能|肾功能|血脂|血糖|电解质|甲状腺功能|肿瘤标志物", 4),
    ),
    "imaging": ((r"超声|彩超|CT|MRI|磁共振|DR\b|X线|放射|影像检查", 9), (r"影像所见|超声所见|检查所见|影像学诊断", 6), (r"回声|密度影|血流信号|强化扫描|扫描序列", 4)),
    "functional": ((r"心电图|动态心电|肺功能|骨密度|脑电图|肌电图|动脉硬化|ABI|baPWV|呼气试验", 9), (r"心率|PR间期|QRS|QTc|FEV1|FVC|T值|Z值", 4)),
    "pathology": ((r"病理报告|病理诊断|组织病理|细胞病理", 10), (r"镜下所见|肉眼所见|免疫组化|切片|蜡块", 7), (r"分化程度|病理分级|TNM分期", 5)),
    "outpatient": ((r"门诊病历|门诊记录|门诊诊断|门诊号", 9), (r"主诉|现病史|既往史|体格检查|处理意见|处置", 4)),
    "inpatient": ((r"入院记录|出院记录|出院小结|住院病案|住院号", 10), (r"入院诊断|出院诊断|住院经过|出院医嘱", 7), (r"病区|床号|手术经过|入院日期|出院日期", 4)),
    "prescription": (
        (r"处方笺|电子处方|门诊处方|住院处方", 10), (r"药品名称|药物名称|用法用量|每次剂量|给药途径", 6),
        (r"规格.{0,20}(?:剂量|频次|数量)|(?:口服|静滴|静注|外用).{0,20}(?:每日|每次)", 4),
    ),
    "billing": ((r"医疗收费票据|医疗票据|收费收据|费用清单|结算单", 10), (r"总金额|合计金额|医保支付|统筹支付|个人自付|自费金额", 7), (r"收费项目|项目金额|票据号|发票号", 4)),
    "vaccination": ((r"预防接种|疫苗接种|接种记录|接种凭证", 10), (r"疫苗名称|接种剂次|第\d+剂|疫苗批号|接种部位", 7), (r"生产企业|疫苗厂家|下次接种", 4)),
}
CHECKUP_ANCHOR = r"健康体检(?:报告|档案)|体检报告|总检结论|体检综述"

# Labels of business identifiers.
IDENTIFIER_LABELS = ("报告号", "门诊号", "住院号", "体检号", "检查号", "标本号", "条码号")
